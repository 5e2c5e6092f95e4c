import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayline.operators import binning as B
from wayline.operators import grids, maps, resampling, rhythm, shapes
from wayline.operators import sequence as S
from wayline.sources import recorders


def test_ideal_grid_is_found(spark):
    rng, scale, axis = np.random.default_rng(1), 40.0, 17.0
    xy = rng.uniform(0, 200, (20_000, 2))
    d = lattice(xy, np.deg2rad(axis), scale)
    spk = rng.random(len(xy)) < 0.5 * np.exp(-d / (2 * 7**2))
    df = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "spk": spk.astype(int)})).repartition(4)
    got = grids.fit_ideal_grid(df, np.linspace(28, 52, 7).tolist(), np.arange(0, 60, 1.0).tolist()).first()
    assert got.scale == 40.0 and abs((got.orientation + axis) % 60) in (0.0, 59.0, 1.0) and got.pearson > 0.6
    one = grids.fit_ideal_grid(df.withColumn("cell", F.lit("a")), [40.0], [43.0], keys=("cell",)).first()
    assert one.cell == "a" and one.pearson > 0.6


def lattice(p, orient, scale, u=0.0, v=0.0):
    """Squared distance to the nearest of all points of a large lattice."""
    k = np.arange(-40, 41)
    a, b = np.meshgrid(k, k)
    q = np.stack([(a + 0.5 * (b % 2) + u).ravel(), ((b + v) * math.sqrt(3) / 2).ravel()], 1) * scale
    c, s = math.cos(orient), math.sin(orient)
    q = q @ np.array([[c, s], [-s, c]])
    return np.array([((q - x) ** 2).sum(1).min() for x in np.asarray(p)])


def test_lattice_distance_and_fit(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(-30, 30, (60, 2))
    df = spark.createDataFrame(pd.DataFrame(p, columns=["x", "y"]))
    args = [F.lit(float(v)) for v in (0.4, 7.5, 0.3, 0.6)]
    got = [r.d for r in df.select(grids.lattice_distance(F.col("x"), F.col("y"), *args).alias("d")).collect()]
    assert np.allclose(got, lattice(p, 0.4, 7.5, 0.3, 0.6))
    points = grids.lattice_points(spark, math.pi / 12, 9.0, 0.0, 0.0, -25, 25).withColumn("w", F.lit(1.0))
    fit = grids.fit_lattice(points, 12, [7.0, 8.0, 9.0, 10.0]).first()
    assert fit.scale == 9.0 and math.isclose(fit.orient, math.pi / 12, abs_tol=1e-9) and fit.cost < 1e-6


def test_warp_finds_a_shift(spark):
    rng = np.random.default_rng(3)
    a = rng.random((24, 24))
    b = np.full_like(a, np.nan)
    b[:, :22] = a[:, 2:]  # b(x) = a(x + 2)
    table = lambda m: spark.createDataFrame([(y, x, float(m[y, x])) for y in range(24) for x in range(24) if not np.isnan(m[y, x])], "gy int, gx int, rate double")
    got = grids.warp(table(a), table(b), 3, 2.0).where("gy between 6 and 17 and gx between 8 and 17").collect()
    assert got and all((r.dy, r.dx) == (0, 2) and r.r > 0.99 for r in got)
    assert grids.warp_summary(grids.warp(table(a), table(b), 3, 2.0)).first().n > 300


def test_drift_of_runs(spark):
    y, x = np.mgrid[:20, :20]
    rate = 0.05 + 2 * np.exp(-((y - 10) ** 2 + (x - 10) ** 2) / 6)
    rows, rng = [], np.random.default_rng(4)
    for run, (dy, dx) in enumerate([(0, 0), (2, -1)]):
        for _ in range(3000):
            gy, gx = rng.integers(4, 16, 2)
            rows.append((run, int(gy), int(gx), int(rng.poisson(rate[gy + dy, gx + dx]))))
    m = spark.createDataFrame([(int(a), int(b), float(rate[a, b])) for a in range(20) for b in range(20)], "gy int, gx int, rate double")
    ll = grids.drift_likelihood(spark.createDataFrame(rows, "run int, gy int, gx int, k int"), m, (20, 20), 4)
    for mode in ("mean", "peak"):
        got = {r.run: (round(r.dy), round(r.dx)) for r in grids.drift(ll, mode).collect()}
        assert got == {0: (0, 0), 1: (2, -1)}
    assert grids.drift_summary(grids.drift(ll)).first().n == 2


def test_shapes(spark):
    c, r = shapes.Circle(50, 50, 40), shapes.Rectangle(0, 100, 20, 80)
    m = {(x.gy, x.gx): x.label for x in c.moved(0, 0).mask(spark, 100, 100, 10, 15).collect()}
    assert len(m) == 100 and m[0, 0] == 0 and m[5, 5] == 1 and m[5, 1] == 2
    assert {x.label for x in r.mask(spark, 100, 100, 10).collect()} == {0, 1}


def test_filled_and_weighted_maps(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, None), (0, 3, 4.0), (1, 0, None)], "gy int, gx int, rate double")
    got = {(r.gy, r.gx): r.rate for r in B.fill_unvisited(m, "nearest").collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (0, 2): 4.0, (0, 3): 4.0, (1, 0): 1.0}
    assert B.fill_unvisited(m, 0).where("rate = 0").count() == 3
    nothing = m.withColumn("rate", F.lit(None).cast("double"))
    assert B.fill_unvisited(nothing, "nearest").where("rate is null").count() == 5
    assert maps.autocorrelation(nothing).count() == 0


def test_radial_windowed_autocorrelation(spark):
    n = 400
    pos = spark.createDataFrame([(i, float(i % 20), 0.0) for i in range(n)], "i long, x double, y double")
    spikes = spark.createDataFrame([(i,) for i in range(0, n, 20)], "pos_i long")
    got = {r.d: r.rate for r in maps.windowed_autocorrelation(spikes, pos, 60, 1, 1.0, (1.0, 20.0), 1, 5, radial=True).collect()}
    assert got[0] > 0 and all(v in (None, 0.0) for d, v in got.items() if d)


def test_runs_and_sums(spark):
    labels = [0, 1, 1, 2, 2, 0, 0, 1, 1, 1, 0, 5]
    values = [3, 5, 8, 9, 1, 2, 5, 8, 5, 4, 9, 2]
    df = spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(labels, values))], "i long, l int, v double")
    for chunk_df in (df, df.repartition(4)):
        got = [r.c for r in S.segmented_sum(chunk_df, F.col("v"), "l", "c").orderBy("i").collect()]
        assert got == [None, 5, 13, 9, 10, None, None, 8, 13, 17, None, 2]
    assert [r.n for r in S.label_changes(df, "l", "n").orderBy("i").collect()] == [0, 1, 1, 2, 2, 0, 0, 3, 3, 3, 0, 4]
    assert [r.n for r in S.label_changes(df, "l", "n", least=2).orderBy("i").collect()] == [0, 1, 1, 2, 2, 0, 0, 3, 3, 3, 0, 0]


def test_percentiles(spark, monkeypatch):
    x = np.random.default_rng(5).gamma(0.3, 10, 5000).round(3)
    df = spark.createDataFrame(pd.DataFrame({"v": np.append(x, np.nan)})).select(F.when(~F.isnan("v"), F.col("v")).alias("v"))
    for few in (200_000, 100):
        monkeypatch.setattr(S, "FEW", few)
        assert np.allclose(S.percentiles(df, "v", [0.0, 0.02, 0.5, 0.75, 1.0]), np.percentile(x, [0, 2, 50, 75, 100]))
    assert S.percentiles(df.limit(0), "v", [0.5]) == [None]


def test_matched_groups(spark):
    rng = np.random.default_rng(6)
    side = lambda n, m: spark.createDataFrame([(int(k), float(m + k % 5 + rng.random() * 0.1)) for k in range(n) for _ in range(3)], "label int, value double")
    got = resampling.matched(side(30, 0), side(18, 2), 1.0).collect()
    a, b = ([r for r in got if r.side == s] for s in "ab")
    assert len(a) == len(b) > 0 and [r.to for r in sorted(a, key=lambda r: r.label)] == list(range(1, len(a) + 1))
    assert all(r.label != 0 for r in got)


def test_binned_bootstrap(spark):
    rng = np.random.default_rng(7)
    x = rng.exponential(10, 2000)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(2000), "x": x, "y": x + rng.normal(0, 1, 2000)}))
    r = resampling.binned_bootstrap(df, 20, 20.0, high=30.0).first()
    assert r.n_bins == 5 and 0.95 < r.low <= r.r <= r.high <= 1


def test_rhythm(spark):
    rng = np.random.default_rng(8)
    assert np.isclose(rhythm.chi_square_above(3.841, 1), 0.05, atol=1e-4) and np.isclose(rhythm.chi_square_above(9.488, 4), 0.05, atol=1e-4) and np.isclose(rhythm.chi_square_above(7.815, 3), 0.05, atol=1e-4)
    low, high = rhythm.poisson_interval(10)
    assert np.isclose(low, 4.795, atol=1e-3) and np.isclose(high, 18.390, atol=1e-3)
    t = (np.arange(601) + 0.5) * 0.001
    truth = np.array([0.0, 0.2, 0.3, 8.0, 0.0, 0.8])
    counts = rng.multinomial(60_000, rhythm.density(truth, t)[0]).astype(float)
    got = rhythm.fit(counts, 0.001)
    assert abs(got["f"] - 8) < 0.2 and got["p_rhythmic"] < 1e-6 and got["r"] > 0.4
    flat = rhythm.fit(rng.multinomial(20_000, np.full(601, 1 / 601)).astype(float), 0.001)
    assert flat["deviance"] < got["deviance"] / 10
    times = np.sort(np.concatenate([np.arange(0, 30, 0.125) + rng.normal(0, 0.008, 240)]))
    spikes = spark.createDataFrame([("a", 1, float(v), k) for k, v in enumerate(times)], "tet string, cell int, t_s double, pos_i long")
    r = rhythm.rhythmicity(spikes).first()
    assert r.n > 500 and abs(r.f - 8) < 0.3


def test_other_recorders(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(0.1, 5, 3), (0.2, 10, 0)], "times double, posSample long, clu int").write.parquet(f"{at}/spk")
    spark.createDataFrame([(i, i / 50, 1.0, 2.0, 3.0, 0.5) for i in range(100)], "i long, times double, x double, y double, speed double, dir double").write.parquet(f"{at}/pos")
    spark.createDataFrame([(k / 1000,) for k in range(500)], "times double").write.parquet(f"{at}/lfp")
    spark.createDataFrame([(50.0, 120.0, 80.0)], "posSampRate double, RightBorder double, TopBorder double").write.parquet(f"{at}/settings")
    t = recorders.probe_trial(spark, at).first()
    assert (t.n_pos, t.pos_fs, t.eeg_fs, t.w, t.h) == (100, 50.0, 1000.0, 120.0, 80.0) and math.isclose(t.duration_s, 1.98)
    assert [tuple(r) for r in recorders.probe_cells(spark, at).collect()] == [(1, 3)]
    spark.createDataFrame([(k / 25, 5.0 + k, 7.0) for k in range(50)], "post double, posx double, posy double").write.parquet(f"{at}/m_pos")
    pos, info = recorders.lab_positions(spark, f"{at}/m_pos")
    i = info.first()
    assert pos.count() == 99 and math.isclose(i.duration_s, 2.0) and i.w == 49.0 and not i.uneven
    spark.createDataFrame([(0, 1.0, 250.0), (1, 2.0, None)], "i long, EEG double, Fs double").write.parquet(f"{at}/m_eeg")
    eeg, fs = recorders.lab_field_signal(spark, f"{at}/m_eeg")
    assert eeg.count() == 2 and fs == 250.0
    spark.createDataFrame([(0.5,), (None,)], "cellTS double").write.parquet(f"{at}/m_cell")
    assert [tuple(r) for r in recorders.lab_spikes(spark, f"{at}/m_cell", 2, 4).collect()] == [(2, 4, 0.5, 25)]
    rewards = spark.createDataFrame([(float(k + 1), 99.0 if k % 4 == 3 else float(k), 0.0) for k in range(12)], "t_s double, x double, y double")
    got = recorders.reward_trials(rewards, 0.0).orderBy("trial").collect()
    assert [r.offset for r in got] == [-3, -2, -1, 0, 1, 2, -1, 0, 1, 2, -1, 0] and [r.start_s for r in got][:2] == [0.0, 1.0]
    assert [r.trial_n for r in got] == [1, 2, 3, 4, 1, 2, 3, 4, 1, 2, 3, 4]
