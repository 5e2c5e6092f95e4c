import heapq

import numpy as np
from pyspark.sql import functions as F

from wayline.operators import fields, maps, shapes


def lattice(n, scale, angles):
    """Sum of plane waves: three 60 degrees apart make a triangular lattice, two at right angles a square one."""
    y, x = np.mgrid[:n, :n]
    k = 4 * np.pi / np.sqrt(3) / scale
    return sum(np.cos(k * (np.cos(t) * x + np.sin(t) * y)) for t in np.deg2rad(angles))


def test_lattices(spark):
    n, scale = 25, 8.0
    planted = {"triangle": lattice(n, scale, (0, 60, 120)), "square": lattice(n, scale, (10, 100))}
    rows = [(k, y, x, float(m[y, x])) for k, m in planted.items() for y in range(n) for x in range(n)]
    m = spark.createDataFrame(rows, "cell string, gy int, gx int, rate double").repartition(3)
    ac = maps.autocorrelation(m, ("cell",))
    got = {r.cell: r for r in fields.grid_measures(ac, ("cell",), 2.0).collect()}
    t = got["triangle"]
    assert t.n_peaks == 7 and abs(t.scale - 2 * scale) < 1.5 and t.gridness > 0.7
    assert min(abs(t.orientation - 30), 60 - abs(t.orientation - 30)) < 5
    assert got["square"].gridness < 0
    one = {(r.dy, r.dx): r.r for r in maps.autocorrelation(m.where("cell = 'square'").drop("cell")).collect()}
    by_key = {(r.dy, r.dx): r.r for r in ac.where("cell = 'square'").collect()}
    assert one.keys() == by_key.keys() and all(np.isclose(one[k], by_key[k], atol=1e-9) for k in one if one[k] is not None)


def test_fields_and_rotation(spark):
    y, x = np.mgrid[:20, :20]
    bump = lambda cy, cx, h: h * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 8)
    a = bump(5, 5, 10) + bump(14, 14, 6)
    a[0, 19] = 3
    rows = [(1, i, j, None if (i, j) == (5, 6) else float(a[i, j])) for i in range(20) for j in range(20)]
    m = spark.createDataFrame(rows, "cell int, gy int, gx int, rate double").repartition(3)
    got = {(r.gy, r.gx): r.label for r in fields.find_fields(m, ("cell",), 1.0, least_cm2=4.0).collect()}
    want = {(i, j): 1 + (a[i, j] < 6 and i + j > 20) for i in range(20) for j in range(20) if (a[i, j] > 5 and i + j < 20 and (i, j) != (5, 6)) or (a[i, j] > 3 and i + j > 20)}
    assert {k: v for k, v in got.items() if v == 1}.keys() == {k for k in want if k[0] + k[1] < 20}
    assert {k for k, v in got.items() if v == 2} == {k for k in want if k[0] + k[1] > 20}
    assert fields.find_fields(m.limit(0), ("cell",), 1.0).count() == 0
    b = np.arange(25.0).reshape(5, 5)
    assert np.allclose(fields.rotated(b, 0), b) and np.allclose(fields.rotated(b, 180), b[::-1, ::-1])
    flat = fields.measures(np.zeros((9, 9)), 1.0)
    assert flat["n_peaks"] == 0 and np.isnan(flat["gridness"])


def test_components_and_areas(spark):
    rng = np.random.default_rng(12)
    inside = rng.random((12, 15)) < 0.4
    got, seen = fields.components(inside), {}
    for y, x in zip(*np.nonzero(inside)):  # flood one by one
        if (y, x) in seen:
            continue
        stack, group = [(y, x)], {(y, x)}
        while stack:
            a, b = stack.pop()
            for p in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if p not in group and 0 <= p[0] < 12 and 0 <= p[1] < 15 and inside[p]:
                    group.add(p)
                    stack.append(p)
        top = max(a * 15 + b for a, b in group)
        seen |= {p: top for p in group}
    assert all(got[p] == t for p, t in seen.items()) and (got[~inside] == -1).all()
    a = np.zeros((6, 6))
    a[1:3, 1:3], a[4, 4] = 5, 3
    assert fields.extent_of(a, (1, 1)).sum() == 4
    m = spark.createDataFrame([("c", y, x, float(a[y, x])) for y in range(6) for x in range(6)], "cell string, gy int, gx int, rate double")
    both = fields.find_fields(m, ("cell",), 1.0, 0.5, 1.0, whole=True)
    areas = {r.label: (r.area, r.cy, r.cx) for r in fields.field_areas(both, ("cell",), 1.0).collect()}
    assert areas == {1: (4.0, 2.0, 2.0), 2: (1.0, 4.5, 4.5)}
    s = fields.area_summary(fields.field_areas(both, ("cell",), 1.0), ("cell",)).first()
    assert (s.n, s.median_area, s.mean_area) == (2, 2.5, 2.5) and np.isclose(s.geomean_area, 2.0)
    assert {r.label for r in fields.find_fields(m, ("cell",), 1.0, 0.5, 1.0, whole=True, relative=(1, 0.6)).collect()} == {1}


def test_triangles(spark):
    p = [(0.0, 0.0), (10.0, 0.0), (5.0, 8.66), (15.0, 8.66), (100.0, 0.0)]
    areas = spark.createDataFrame([("c", k + 1, 1.0, y, x) for k, (x, y) in enumerate(p)], "cell string, label int, area double, cy double, cx double")
    got = fields.field_triangles(areas, ("cell",)).orderBy("a", "b").collect()
    assert [(r.a, r.b, r.c) for r in got] == [(1, 2, 3), (2, 3, 4)] and all(abs(r.area - 43.3) < 0.1 and abs(r.side - 10) < 0.01 for r in got)
    assert fields.field_triangles(areas.limit(2), ("cell",)).count() == 0


def test_line_autocorrelation(spark):
    d = np.arange(100)
    rate = 1 + np.exp(-d / 60) * np.cos(2 * np.pi * d / 40)
    ac = spark.createDataFrame([(int(k), float(v)) for k, v in zip(d, rate)], "d int, rate double")
    r = fields.line_autocorrelation_properties(ac, 1.0, smoothing=7.0).first()
    assert abs(r.scale - 40) < 2 and abs(r.trough - 20) < 2 and 0.1 < r.clusteriness < 0.4 and 0.3 < r.width < 1.1
    flat = fields.line_autocorrelation_properties(ac.withColumn("rate", F.lit(1.0)), 1.0).first()
    assert flat.scale is None and flat.width is None


def flooded(heights, markers):
    """Flooding with a heap of heights and arrivals."""
    label, heap, age = {m: m for m in markers}, [], 0
    h, w = heights.shape
    for m in markers:
        heapq.heappush(heap, (-heights.flat[m], age, m))
        age += 1
    while heap:
        _, _, k = heapq.heappop(heap)
        y, x = divmod(k, w)
        for ny, nx in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= ny < h and 0 <= nx < w and ny * w + nx not in label:
                label[ny * w + nx] = label[k]
                heapq.heappush(heap, (-heights[ny, nx], age, ny * w + nx))
                age += 1
    return np.array([label.get(k, -1) for k in range(h * w)]).reshape(h, w)


def test_flooding_with_plateaus():
    rng = np.random.default_rng(3)
    for steps in (2, 4, 40, 256):
        for _ in range(20):
            a = rng.integers(0, steps, (rng.integers(1, 14), rng.integers(1, 14)))
            a = a * 255 // max(1, steps - 1)
            markers = fields.maxima(a)
            tops = [(y, x) for y in range(a.shape[0]) for x in range(a.shape[1]) if a[y, x] > 0 and a[y, x] == a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max()]
            assert {divmod(m, a.shape[1]) for m in markers} <= set(tops) and bool(markers) == bool(tops)
            assert (fields.flood(a, markers) == flooded(a, markers)).all()


def test_percentile_fields_with_holes_and_crop(spark):
    a = np.zeros((12, 12))
    a[2:7, 2:7] = 5.0
    a[4, 4] = 0.0  # a hole
    a[9, 9:11] = 7.0
    m = spark.createDataFrame([("c", y, x, float(a[y, x])) for y in range(12) for x in range(12)], "cell string, gy int, gx int, rate double")
    for above in (75.0, "mean"):
        got = {(r.gy, r.gx): r.label for r in fields.find_fields(m, ("cell",), 1.0, least_cm2=1.0, above=above).collect()}
        assert got == {**{(y, x): 2 for y in range(2, 7) for x in range(2, 7)}, (9, 9): 1, (9, 10): 1}
    found = fields.find_fields(m, ("cell",), 1.0, least_cm2=1.0, above="mean")
    cropped = fields.crop(found, shapes.Rectangle(3.0, 12.0, 0.0, 12.0), 12.0, 12.0, 1.0)
    assert {(r.gy, r.gx) for r in cropped.collect()} == {(y, x) for y, x in got if x >= 4}


def sheared(matrix, size=61, scale=14.0):
    y, x = np.mgrid[:size, :size] - size // 2
    u = np.linalg.inv(matrix) @ np.stack([y.ravel(), x.ravel()])
    waves = [np.cos(4 * np.pi / np.sqrt(3) / scale * (u[0] * np.sin(t) + u[1] * np.cos(t))) for t in np.deg2rad([15, 75, 135])]
    return np.sum(waves, axis=0).reshape(size, size) / 3


def test_stretched_lattices_get_their_gridness_back():
    plain = fields.measures(sheared(np.eye(2)), 1.0)
    assert plain["gridness"] > 1.2 and fields.measures(sheared(np.eye(2)), 1.0, ellipse=True)["stretch"] < 1.05
    for matrix in (np.diag([1.3, 1 / 1.3]), np.array([[1.0, 0.3], [0.0, 1.0]]), np.array([[0.85, 0.1], [0.2, 1.15]])):
        a = sheared(matrix)
        before, after = fields.measures(a, 1.0), fields.measures(a, 1.0, ellipse=True)
        assert before["gridness"] < plain["gridness"] - 0.15
        assert abs(after["gridness"] - plain["gridness"]) < 0.05 and abs(after["scale"] - plain["scale"] * np.sqrt(np.linalg.det(matrix))) < 1.0
        a[0, :5] = np.nan
        assert abs(fields.measures(a, 1.0, ellipse=True)["gridness"] - plain["gridness"]) < 0.05


def test_first_orientation():
    a = sheared(np.eye(2))
    first, mean = (fields.measures(a, 1.0, orientation=o)["orientation"] for o in ("first", "mean"))
    assert 0 < first < 60 and abs((first - mean + 30) % 60 - 30) < 5
