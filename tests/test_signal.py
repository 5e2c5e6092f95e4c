import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayline.operators import signal as G
from wayline.operators import sequence as S


def frame(spark, x, **more):
    return spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "v": x, **more})).repartition(3)


def test_theta_of_a_sine(spark):
    rng, n, fs = np.random.default_rng(1), 6000, 250.0
    x = 3 * np.sin(2 * np.pi * 8 * np.arange(n) / fs) + rng.standard_normal(n)
    t = G.theta(frame(spark, x), "v", fs, chunk=1700, bad=F.col("i") == 3000).orderBy("i").toPandas()
    assert len(t) == n and t.filtered.isna().sum() == 1 and t.phase.isna().sum() == 1
    x[3000] = 0
    taps = G.band_taps(251, 6, 12, fs, "blackman")
    assert np.isclose(abs(np.sum(taps * np.exp(-2j * np.pi * 9 / fs * np.arange(251)))), 1)
    want = np.convolve(np.pad(x, 250, mode="reflect", reflect_type="odd"), np.convolve(taps, taps[::-1]), "same")[250:-250]
    good = t.filtered.notna()
    assert np.allclose(t.filtered[good], want[good], atol=1e-9)
    want[3000] = 0
    f = np.fft.fft(want)
    f[1 : n // 2] *= 2
    f[n // 2 + 1 :] = 0
    whole = np.fft.ifft(f)
    assert np.abs(t.amp - np.abs(whole))[good].max() < 1e-9
    turn = np.angle(np.exp(1j * (t.phase - np.angle(whole) - np.pi)))
    assert np.abs(turn[good]).max() < 1e-9
    assert abs(t.freq[300:-300].mean() - 8) < 0.05


def analytic(x):
    n = len(x)
    f = np.fft.fft(x)
    f[1 : (n + 1) // 2] *= 2
    f[n // 2 + 1 :] = 0
    return np.fft.ifft(f)


def test_analytic_signal_of_whole_recordings(spark):
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.standard_normal(100_000))
    got = G.quadrature(frame(spark, x), "v", 250).orderBy("i").toPandas()
    assert len(got) == len(x) and np.abs(got.imag - analytic(x).imag).max() < 1e-6
    # several recordings of their own lengths, the last filled up; gaps count as 0
    parts = {"a": rng.standard_normal(500), "b": rng.standard_normal(37), "c": rng.standard_normal(1)}
    rows = pd.concat([pd.DataFrame({"r": k, "i": np.arange(len(v)), "v": v}) for k, v in parts.items()])
    rows = rows[~((rows.r == "a") & (rows.i == 7))]
    got = G.quadrature(spark.createDataFrame(rows), "v", 10, keys=("r",)).toPandas()
    for k, v in parts.items():
        full = np.pad(v, (0, -len(v) % 10))
        full[7] = 0 if k == "a" else full[7]
        mine = got[got.r == k].set_index("i").imag.sort_index()
        assert len(mine) == len(v) - (k == "a") and np.allclose(mine, analytic(full).imag[mine.index], atol=1e-9)


def test_chunks_do_not_matter(spark):
    x = np.random.default_rng(2).standard_normal(1000)
    taps = G.band_taps(51, 6, 12, 50.0)
    a, b, c = (G.band_pass(frame(spark, x), F.col("v"), taps, chunk=k).orderBy("i").toPandas().filtered for k in (7, 100, 5000))
    assert np.allclose(a, b) and np.allclose(b, c)
    assert G.band_pass(frame(spark, x[:1]), F.col("v"), taps).count() == 1


def test_phase_histogram(spark):
    phases = spark.createDataFrame([(0, 0.0), (1, 2 * math.pi), (2, None), (3, 1.0)], "i long, phase double")
    spikes = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 2)], "cell string, eeg_i long")
    got = {(r.cell, r.b): r.share for r in G.phase_histogram(spikes, phases, ("cell",), 90.0).collect()}
    assert got == {("a", 0): 1.0}


def test_ripples_are_found(spark):
    rng, fs, n = np.random.default_rng(3), 1000.0, 8000
    x = rng.standard_normal(n) * 0.2
    for a in (2000, 5000, 6500):
        x[a : a + 100] += 3 * np.sin(2 * np.pi * 200 * np.arange(100) / fs)
    speed = np.zeros(n)
    speed[4900:5200] = 20  # running: no event
    found = G.ripple_events(frame(spark, x, speed=speed), "v", fs, "speed").orderBy("event").collect()
    assert [round(r.start_s, 1) for r in found] == [2.0, 6.5] and all(r.end_s - r.start_s > 0.05 for r in found)
    mua = frame(spark, np.where((np.arange(n) > 700) & (np.arange(n) < 800), 9.0, 0.0))
    assert G.find_replay_events("MUA", None, mua, fs, fs).count() == 1
    none = G.find_replay_events("SWR", None, mua, fs, fs)
    assert none.count() == 0 and "start_s" in none.columns


def test_spectrum(spark):
    x = np.random.default_rng(4).standard_normal(700) + 5 * np.sin(2 * np.pi * 9 * np.arange(700) / 100)
    for n in (1, 2, 64, 1024):
        got = G.spectrum(frame(spark, x), F.col("v"), n).orderBy("k").toPandas()
        want = np.fft.rfft(x[:n] if n <= 700 else x, n)
        assert len(got) == n // 2 + 1 and np.allclose(got.re + 1j * got.im, want)
    p = G.power_spectrum(frame(spark, x), "v", 100.0)
    want = np.abs(np.fft.rfft(x - x.mean(), 1024)) ** 2 / 700
    assert np.allclose(p.orderBy("i").toPandas().power, want)
    peak = G.band_peak(p, 0.2, (6, 12)).first()
    assert abs(peak.peak_freq - 9) < 0.2 and peak.s2n > 10


def test_smoothing_at_the_ends(spark):
    x, w = np.random.default_rng(5).standard_normal(40), [0.1, 0.2, 0.4, 0.2, 0.1]
    for edge, mode in (("reflect", "symmetric"), ("nearest", "edge")):
        for m in (1, 2, 3, 40):
            got = S.smooth(frame(spark, x[:m]), "v", w, "s", edge=edge).orderBy("i").toPandas().s
            assert np.allclose(got, np.convolve(np.pad(x[:m], 2, mode=mode), w, "valid"))


def test_low_spectrum_and_slopes(spark):
    a = np.random.default_rng(6).standard_normal((5, 6))
    m = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(5) for x in range(6)], "gy int, gx int, rate double")
    got = {(r.ky, r.kx): r.re + 1j * r.im for r in G.low_spectrum(m, "rate", 2, 8).collect()}
    want = np.fft.fft2(a, (8, 8))
    assert len(got) == 25 and all(np.isclose(v, want[k]) for k, v in got.items())
    line = 3.0 + 2.0 * np.arange(31)
    assert np.isclose(np.dot(G.slope_taps(31), line), 2.0)
    assert S.running_sum(frame(spark, line), F.col("v"), "s").count() == 31


def test_next_known_value_is_linear_in_a_chunk(spark):
    import time

    n = 65_536
    df = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 1000 == 999, F.col("id")).alias("v"))
    t = time.time()
    assert S.last_known(df, F.col("v"), "next", ahead=True).where("next = floor(i / 1000) * 1000 + 999").count() == n // 1000 * 1000
    assert time.time() - t < 30


def test_peaks_by_brute_force(spark):
    from wayline.operators import peaks as P

    rng = np.random.default_rng(9)
    x = np.convolve(rng.random(1500) * 10, np.ones(7) / 7, "same").round(2)
    df = frame(spark, x)
    fs, reach = 5.0, 50
    got = {r.i: (r.left, r.right, r["distinct"]) for r in P.find_peaks(df, "v", fs, 5.0).collect()}
    low = np.where(x >= 5, x, 0)
    at = [p for p in range(1, len(x) - 1) if low[p] > low[p - 1] and low[p] > low[p + 1]]
    taken = np.zeros(len(x) + reach, bool)
    for p in sorted(at, key=lambda p: (-x[p], -p)):
        left = next((k for k in range(p - 1, max(0, p - reach) - 1, -1) if x[k] < x[p] / 2), max(0, p - reach))
        right = next((k for k in range(p, min(len(x), p + reach)) if x[k] < x[p] / 2), p + reach)
        assert got[p] == (left, right, not taken[left:right].any())
        taken[left:right] = True
    assert got.keys() == set(at) and any(d for *_, d in got.values())
    pos = frame(spark, x).select("i", F.col("i").cast("double").alias("x"), F.lit(0.0).alias("y"))
    for r in P.peak_widths(P.find_peaks(df, "v", fs, 5.0), pos).collect():
        left, right, _ = got[r.i]
        assert r.width == min(right, len(x) - 1) - left
    assert P.mean_and_sem(df, "v").first().n == 1500
