import math
import random

import numpy as np
from pyspark.sql import functions as F

from wayline.operators import sequence, tracking
from wayline.operators import tracking as T


def test_jump_filter_matches_a_loop(spark):
    rng = random.Random(1)
    rows = [(t, i, None if rng.random() < 0.2 else rng.uniform(0, 20), rng.uniform(0, 20)) for t in range(4) for i in range(60)]
    want = {}
    for t in range(4):
        last = None
        for _, i, x, y in (r for r in rows if r[0] == t):
            ok = x is not None and (last is None or (x - last[1]) ** 2 + (y - last[2]) ** 2 <= ((i - last[0]) * 3.0) ** 2)
            last = (i, x, y) if ok else last
            want[t, i] = ok
    df = spark.createDataFrame(rows, "trial int, i long, x double, y double").repartition(3)
    assert {(r.trial, r.i): r.ok for r in tracking.jump_filter(df, 3.0, ("trial",)).collect()} == want


def test_jump_filter_within_one_track(spark):
    """Chunks that guess their start wrong: long masked stretches, and a wrong place that many samples share."""
    rng = np.random.default_rng(4)
    n = 3000
    xy = np.cumsum(rng.normal(0, 1, (n, 2)), axis=0)
    xy[rng.random(n) < 0.1] += 80
    xy[400:520], xy[900:905], xy[1500:1650] = np.nan, xy[900:905] + 500, xy[1500:1650] + 300
    want, last = [], None
    for i, (x, y) in enumerate(xy):
        good = x == x and (last is None or (x - last[1]) ** 2 + (y - last[2]) ** 2 <= ((i - last[0]) * 2.5) ** 2)
        last = (i, x, y) if good else last
        want.append(bool(good))
    df = spark.createDataFrame([(i, *(None if v != v else float(v) for v in p)) for i, p in enumerate(xy)], "i long, x double, y double").repartition(4)
    for chunk, overlap in ((100, 10), (64, 64), (1000, 3)):
        got = [r.ok for r in tracking.jump_filter(df, 2.5, (), chunk, overlap).orderBy("i").collect()]
        assert got == want
    assert 0.5 < np.mean(want) < 0.95
    nothing = df.withColumn("x", F.lit(None).cast("double"))
    assert not any(r.ok for r in tracking.jump_filter(nothing, 2.5, (), 100, 10).collect())


def test_series_across_chunks(spark):
    """Chunks of a few rows give what one chunk gives."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(100)], "i long, v double").repartition(3)
    for chunk in (3, 7, 1000):
        a = sequence.running_sum(df, F.col("v"), "s", chunk=chunk)
        a = sequence.previous(a, F.col("v"), "p", chunk=chunk)
        a = sequence.last_known(a, F.col("v"), "k", chunk=chunk)
        a = sequence.last_known(a, F.col("v"), "n", ahead=True, chunk=chunk)
        a = sequence.framed(a, {"m": lambda w: F.sum("v").over(w.rowsBetween(-2, 1))}, 2, 1, chunk=chunk)
        got = sorted(map(tuple, a.select("i", "s", "p", "k", "n", "m").collect()), key=lambda r: r[0])
        if chunk == 3:
            first = got
        assert got == first


def test_clean_track_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n, fs, ppm = 400, 50.0, 300.0
    centre = np.cumsum(rng.normal(0, 2, (n, 2)), axis=0) + 250
    led = np.stack([centre + 6, centre - 6], axis=1)
    pix = np.stack([rng.normal(60, 5, n), rng.normal(20, 5, n)], axis=1)
    for a in (100, 101, 250):
        led[a], pix[a] = led[a, ::-1].copy(), pix[a, ::-1].copy()
    led[rng.random(n) < 0.1, 0] += 300
    gone = rng.random((n, 2)) < 0.1
    rows = [("r", i, k, None if gone[i, k] else float(led[i, k, 0]), float(led[i, k, 1]), float(pix[i, k])) for i in range(n) for k in (0, 1)]
    df = spark.createDataFrame(rows, "trial string, i long, led int, px double, py double, npix double").repartition(3)

    p = led.copy()
    p[gone | (p < 0).any(axis=2) | (p[:, :, 0] > 700) | (p[:, :, 1] > 500)] = np.nan
    d = lambda a, b: np.hypot(*(p[1:, a] - p[:-1, b]).T)
    cross = np.append((d(0, 0) - d(0, 1) > 5) | (d(1, 1) - d(1, 0) > 5), False)
    m, s = pix.mean(axis=0), pix.std(axis=0)
    swap = cross & ((m[0] - pix[:, 0]) / s[0] > (pix[:, 0] - m[1]) / s[1])
    assert swap.any()
    p[swap] = p[swap][:, ::-1]
    for k in (0, 1):
        last = None
        for i in range(n):
            if np.isnan(p[i, k, 0]):
                continue
            if last is not None and ((p[i, k] - p[last, k]) ** 2).sum() > (4.0 * ppm / fs * (i - last)) ** 2:
                p[i, k] = np.nan
            else:
                last = i
    p = p * 100 / ppm
    x1, x2 = np.nanpercentile(p[:, 0, 0], [0.5, 99.5])
    y1, y2 = np.nanpercentile(p[:, 0, 1], [0.5, 99.5])
    out = (p[:, :, 0] < x1) | (p[:, :, 0] > x2) | (p[:, :, 1] < y1) | (p[:, :, 1] > y2)
    p[out] = np.nan
    p -= [x1 - 0.01 * (x2 - x1), y1 - 0.01 * (y2 - y1)]
    known = ~np.isnan(p[:, :, 0])
    weight = known.sum(axis=0) / known.sum()
    for k in (0, 1):
        for c in (0, 1):
            v = np.interp(np.arange(n), np.flatnonzero(known[:, k]), p[known[:, k], k, c])
            v = np.pad(v, (10, 9), "edge")
            p[:, k, c] = [v[i : i + 20].mean() for i in range(n)]
    want = (p * weight[None, :, None]).sum(axis=1)
    got = tracking.clean(df, ("trial",), fs, ppm, (700, 500), shape="rectangle").orderBy("i").collect()
    assert np.allclose([(r.x, r.y) for r in got], want) and np.allclose([r.w for r in got], (x2 - x1) * 1.02)
    assert np.allclose([r.dir for r in got], np.arctan2(p[:, 1, 0] - p[:, 0, 0], p[:, 1, 1] - p[:, 0, 1]))


def test_circle_box_and_rigid(spark):
    import math

    rng = random.Random(4)
    rows = []
    for i in range(6000):
        r, t = 40 * math.sqrt(rng.random()), rng.uniform(0, 2 * math.pi)
        rows.append((1, i, 50 + r * math.cos(t), 60 + r * math.sin(t)))
    df = spark.createDataFrame(rows, "trial int, i long, x double, y double")
    c = tracking.arc_circle(df, ("trial",)).first()
    assert abs(c.cx - 50) < 2 and abs(c.cy - 60) < 2 and abs(c.r - 40) < 2
    boxed = tracking.in_fixed_box(tracking.in_circle(df, tracking.arc_circle(df, ("trial",)), ("trial",)), width=60.0)
    known = boxed.where("x is not null")
    assert boxed.count() == 6000 and 0 < known.count() < 6000 and known.where("x < 0 or x >= 60").count() == 0
    turned = tracking.rigid(df.limit(1), 100, 120, degrees=90).first()
    assert math.isclose(turned.x, max(50 - (rows[0][3] - 60), 0)) and math.isclose(turned.y, max(60 + rows[0][2] - 50, 0))


def test_ellipse(spark):
    t = np.linspace(0, 2 * np.pi, 50, endpoint=False)
    along, across = 30 * np.cos(t), 10 * np.sin(t)
    x, y = 100 + along * np.cos(0.5) - across * np.sin(0.5), -20 + along * np.sin(0.5) + across * np.cos(0.5)
    rows = [("a", float(p), float(q)) for p, q in zip(x, y)] + [("line", float(k), float(k)) for k in range(20)] + [("few", 1.0, 2.0), ("few", None, 2.0)]
    got = {r.cell: r for r in T.fit_ellipse(spark.createDataFrame(rows, "cell string, x double, y double"), ("cell",)).collect()}
    e = got["a"]
    assert np.allclose([e.cx, e.cy, e.major, e.minor, e.angle], [100, -20, 30, 10, 0.5], atol=1e-6)
    assert got["line"].cx is None and got["few"].major is None and got["few"].n == 1
    df = spark.createDataFrame(rows[:50], "cell string, x double, y double")
    u, v = T.circled(F.col("x"), F.col("y"), (e.cx, e.cy, e.major, e.minor, e.angle))
    r = [math.hypot(p.u - 100, p.v + 20) for p in df.select(u.alias("u"), v.alias("v")).collect()]
    assert np.allclose(r, math.sqrt(300))


def test_track_edges(spark):
    pos = spark.createDataFrame([(i, float(i % 100), float(i // 100)) for i in range(1000)], "i long, x double, y double")
    edges = T.fit_track(pos, ends=10, margin=5.0)
    assert len(edges) == 3 and edges[0].ax == -5 and edges[2].bx == 104 and math.isclose(edges[1].base, 109)
    at = pos.select(T.nearest_edge(F.col("x"), F.col("y"), edges).alias("s")).select("s.edge", "s.linear")
    assert at.where("edge is null").count() == 0
