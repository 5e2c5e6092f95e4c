"""Clean-up of tracked positions and shape fits."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.circular import ratio
from wayline.operators import sequence as S


#: Samples of a track that one task runs through, and how many before them.
CHUNK, OVERLAP = 1 << 16, 1 << 10


def jump_filter(pos: DataFrame, step: float, keys: tuple[str, ...], chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keys, i, ok``: whether a sample is within reach of the last good one, ``step`` for each sample since then.

    The first known sample is good, a masked one never is. A recurrence over the
    samples of a track whose state is the last good one: two runs through it that
    both take a sample for good are one from there on, so chunks of a track run side
    by side, each from some samples before it, and those that guessed wrong again.
    """

    def see(rows: pd.DataFrame, last: np.ndarray | None) -> tuple[dict[str, list], np.ndarray | None]:
        ok = []
        at = None if last is None else tuple(last)
        for i, x, y in zip(rows["i"].tolist(), rows["x"].tolist(), rows["y"].tolist()):
            good = x == x and y == y and (at is None or (x - at[1]) ** 2 + (y - at[2]) ** 2 <= ((i - at[0]) * step) ** 2)
            at = (i, x, y) if good else at
            ok.append(good)
        return {"ok": ok}, None if at is None else np.array(at, float)

    track = pos.select(*keys, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return S.scan_chunks(track, keys, "i", see, {"ok": "boolean"}, chunk, overlap)


def swap_lights(leds: DataFrame, keys: tuple[str, ...], reach: float = 5.0) -> DataFrame:
    """``keys, i, led, px, py, npix`` with the two lights exchanged where they were taken for each other.

    That is where the big light (0) is as small as the small one, in standard
    deviations of either, and one light's next place is nearer to the other's place
    by more than ``reach``. A missing place or size swaps nothing.
    """
    light = lambda n: F.max(F.when(F.col("led") == n, F.struct("px", "py", "npix")))
    wide = leds.groupBy(*keys, "i").agg(light(0).alias("a"), light(1).alias("b"))
    size = wide.groupBy(*keys).agg(*[f(c + ".npix").alias(f"__{n}{c}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for c in "ab"])
    near = S.framed(wide, {"__na": lambda w: F.lead("a").over(w), "__nb": lambda w: F.lead("b").over(w)}, 0, 1, keys).join(size, list(keys))
    gap = lambda p, q: F.hypot(F.col(p)["px"] - F.col(q)["px"], F.col(p)["py"] - F.col(q)["py"])
    crossed = (gap("__na", "a") - gap("__na", "b") > reach) | (gap("__nb", "b") - gap("__nb", "a") > reach)
    shrunken = ratio(F.col("__ma") - F.col("a.npix"), F.col("__sa")) > ratio(F.col("a.npix") - F.col("__mb"), F.col("__sb"))
    swap = F.coalesce(crossed & shrunken, F.lit(False))
    first, second = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    return near.select(*keys, "i", F.posexplode(F.array(first, second)).alias("led", "p")).select(*keys, "i", "led", "p.px", "p.py", "p.npix")


def fit_rectangle(pos: DataFrame, keys: tuple[str, ...], edge: float = 0.5) -> DataFrame:
    """``keys, x1, x2, y1, y2``: percentiles ``edge`` and 100 - ``edge``. Places are of pixels, so few values differ."""
    q = F.array(F.lit(edge / 100), F.lit(1 - edge / 100))
    at = pos.groupBy(*keys).agg(F.percentile("x", q).alias("qx"), F.percentile("y", q).alias("qy"))
    return at.select(*keys, F.col("qx")[0].alias("x1"), F.col("qx")[1].alias("x2"), F.col("qy")[0].alias("y1"), F.col("qy")[1].alias("y2"))


def arc_circle(pos: DataFrame, keys: tuple[str, ...], edge: float = 2.0, arc: float = 15.0, ring: float = 1.0, dwell: float = 0.25 / 360) -> DataFrame:
    """``keys, cx, cy, r``: the circle through each arc's outermost ring that holds more than ``dwell`` of all samples.

    An arc without such a ring counts with the outermost ring of the track.
    """
    box = fit_rectangle(pos, keys, edge).select(*keys, ((F.col("x1") + F.col("x2")) / 2).alias("__x"), ((F.col("y1") + F.col("y2")) / 2).alias("__y"))
    at = pos.join(box, list(keys))
    x, y = F.col("x") - F.col("__x"), F.col("y") - F.col("__y")
    n_arcs = int(360 / arc)
    bins = at.select(*keys, "__x", "__y", F.floor(F.hypot(x, y) / ring).alias("r"), F.least(F.floor((F.degrees(F.atan2(y, x)) + 180) / arc), F.lit(n_arcs - 1)).alias("t"))
    held = bins.groupBy(*keys, "__x", "__y", "r", "t").agg(F.count("*").alias("n"))
    whole = held.groupBy(*keys, "__x", "__y").agg(F.sum("n").alias("__n"), F.max("r").alias("__r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_arcs - 1))).alias("t"))
    arcs = whole.join(held.select(*keys, "r", "t", "n"), [*keys, "t"], "left").groupBy(*keys, "__x", "__y", "t", "__r")
    outer = arcs.agg(F.max(F.when(F.col("n") > dwell * F.col("__n"), F.col("r"))).alias("r")).withColumn("r", (F.coalesce("r", "__r") + 1) * ring)
    angle = F.radians(F.col("t") * arc) - math.pi
    return fit_circle(outer.select(*keys, (F.col("__x") + F.col("r") * F.cos(angle)).alias("x"), (F.col("__y") + F.col("r") * F.sin(angle)).alias("y")), keys).drop("n")


def keep_where(pos: DataFrame, inside: Column) -> DataFrame:
    """``pos`` with places masked (x and y null) unless ``inside`` holds."""
    return pos.withColumns({c: F.when(inside, F.col(c)) for c in ("x", "y")})


def in_rectangle(pos: DataFrame, box: DataFrame, keys: tuple[str, ...], padding: float = 1.02) -> DataFrame:
    """Places outside the rectangle masked, the others moved so that it lies in the middle of a box ``w`` by ``h``, 2 % larger."""
    w, h = (F.col("x2") - F.col("x1")), (F.col("y2") - F.col("y1"))
    out = keep_where(pos.join(box, list(keys)), F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2")))
    moved = {"x": F.col("x") - F.col("x1") + (padding - 1) * w / 2, "y": F.col("y") - F.col("y1") + (padding - 1) * h / 2, "w": w * padding, "h": h * padding}
    return out.withColumns(moved).drop("x1", "x2", "y1", "y2")


def in_circle(pos: DataFrame, circle: DataFrame, keys: tuple[str, ...], padding: float = 1.02) -> DataFrame:
    """As :func:`in_rectangle`, for a circle."""
    out = keep_where(pos.join(circle, list(keys)), F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= F.col("r"))
    half = F.col("r") * padding
    return out.withColumns({"x": F.col("x") - F.col("cx") + half, "y": F.col("y") - F.col("cy") + half, "w": 2 * half, "h": 2 * half}).drop("cx", "cy", "r")


def in_fixed_box(pos: DataFrame, width: float | None = None, height: float | None = None) -> DataFrame:
    """Centres the box ``w`` by ``h`` in one of fixed size, along either axis or both; what falls outside is masked."""
    inside = F.lit(True)
    for c, side, size in (("x", "w", width), ("y", "h", height)):
        if size is not None:
            pos = pos.withColumn(c, F.col(c) - (F.col(side) - size) / 2).withColumn(side, F.lit(float(size)))
            inside = inside & (F.col(c) >= 0) & (F.col(c) < size)
    return keep_where(pos, inside)


def combine_lights(leds: DataFrame, weights: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys, i, x, y, dir``: the lights' weighted mean and the angle from the first to the second, x first; null with one light."""
    place = lambda n, c: F.max(F.when(F.col("led") == n, F.col(c)))
    both = leds.join(weights, [*keys, "led"]).groupBy(*keys, "i")
    mean = [F.sum(F.col("__w") * F.col(c)).alias(c) for c in ("x", "y")]
    return both.agg(*mean, F.atan2(place(1, "x") - place(0, "x"), place(1, "y") - place(0, "y")).alias("dir"))


def light_weights(leds: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys, led, __w``: each light's share of the places known."""
    known = leds.groupBy(*keys, "led").agg(F.count("x").alias("n"))
    total = known.groupBy(*keys).agg(F.sum("n").alias("t"))
    return known.join(total, list(keys)).select(*keys, "led", ratio(F.col("n"), F.col("t")).alias("__w"))


def clean(
    leds: DataFrame, keys: tuple[str, ...], fs: float, ppm: float, window: tuple[float, float], shape: str | None = None, fixed: tuple[float | None, float | None] = (None, None),
    swap: bool = True, max_speed: float | None = 4.0, smoothing_ms: float = 400.0,
) -> DataFrame:
    """``keys, i, x, y, dir, w, h`` in cm from raw lights (``keys, i, led, px, py, npix``).

    In order: places known by half or outside the camera window masked, lights
    exchanged back, jumps faster than ``max_speed`` (m/s) masked, pixels to cm, a
    ``circle`` or ``rectangle`` fitted to the first light and what lies outside it
    masked, a fixed box, weights, gaps filled in, smoothing, lights combined.
    """
    w, h = window
    seen = F.col("px").between(0, w) & F.col("py").between(0, h)
    raw = leds.select(*keys, "i", "led", F.when(seen, F.col("px")).alias("px"), F.when(seen, F.col("py")).alias("py"), "npix")
    if swap:
        raw = swap_lights(raw, keys)
    pos = raw.select(*keys, "i", "led", F.col("px").alias("x"), F.col("py").alias("y"))
    if max_speed is not None:
        ok = jump_filter(pos, max_speed * ppm / fs, (*keys, "led"))
        pos = keep_where(pos.join(ok, [*keys, "led", "i"]), F.col("ok")).drop("ok")
    cm = pos.withColumns({"x": F.col("x") * 100 / ppm, "y": F.col("y") * 100 / ppm, "w": F.lit(float(int(w * 100 / ppm))), "h": F.lit(float(int(h * 100 / ppm)))})
    first = cm.where("led = 0 and x is not null")
    if shape == "circle":
        cm = in_circle(cm.drop("w", "h"), arc_circle(first, keys), keys)
    elif shape == "rectangle":
        cm = in_rectangle(cm.drop("w", "h"), fit_rectangle(first, keys), keys)
    cm = in_fixed_box(cm, *fixed)
    weights = light_weights(cm, keys)
    each = (*keys, "led")
    for c in ("x", "y"):
        cm = S.interpolate(cm, c, c, keys=each)
        cm = S.boxcar(cm, c, max(int(fs * smoothing_ms / 1000), 1), c, each)
    sizes = cm.groupBy(*keys).agg(F.max("w").alias("w"), F.max("h").alias("h"))
    return combine_lights(cm, weights, keys).join(sizes, list(keys))


def rigid(pos: DataFrame, w: float, h: float, dx: float = 0.0, dy: float = 0.0, degrees: float = 0.0) -> DataFrame:
    """Turned about the middle of the box, moved, and kept at 0 or above."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    u, v = F.col("x") - w / 2, F.col("y") - h / 2
    return pos.withColumns({"x": F.greatest(c * u - s * v + w / 2 + dx, F.lit(0.0)), "y": F.greatest(s * u + c * v + h / 2 + dy, F.lit(0.0))})


def fit_circle(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, n, cx, cy, r`` of the algebraic least-squares circle, from moments about the mean; null where points lie on a line."""
    n, s = F.count("*").cast("double"), F.sum
    means = points.groupBy(*keys).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    centred = points.join(means, list(keys)) if keys else points.crossJoin(F.broadcast(means))  # one row
    u, v = F.col("x") - F.col("__mx"), F.col("y") - F.col("__my")
    m = centred.groupBy(*keys, "__mx", "__my").agg(
        n.alias("n"), s(u * u).alias("uu"), s(v * v).alias("vv"), s(u * v).alias("uv"), s(u * u * u + u * v * v).alias("p"), s(v * v * v + v * u * u).alias("q")
    )
    det = 2 * (F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv"))
    a = ratio(F.col("p") * F.col("vv") - F.col("q") * F.col("uv"), det)
    b = ratio(F.col("q") * F.col("uu") - F.col("p") * F.col("uv"), det)
    r = F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n"))
    return m.select(*keys, F.col("n").cast("long").alias("n"), (F.col("__mx") + a).alias("cx"), (F.col("__my") + b).alias("cy"), r.alias("r"))


@dataclass(frozen=True)
class Edge:
    """An edge of a track, from (ax, ay) to (bx, by), that begins at ``base`` along it."""

    name: int
    ax: float
    ay: float
    bx: float
    by: float
    base: float


def nearest_edge(x: Column, y: Column, edges: list[Edge]) -> Column:
    """``edge, linear`` of a position: the nearest edge, ties to the smaller name, and the place along the track."""
    found = []
    for e in edges:
        ux, uy = e.bx - e.ax, e.by - e.ay
        f = F.least(F.greatest(((x - e.ax) * ux + (y - e.ay) * uy) / F.lit(ux * ux + uy * uy), F.lit(0.0)), F.lit(1.0))
        d = F.sqrt(F.pow(x - e.ax - f * ux, 2) + F.pow(y - e.ay - f * uy, 2))
        found.append(F.struct(F.round(d, 9).alias("d"), F.lit(e.name).alias("edge"), (F.lit(e.base) + f * math.hypot(ux, uy)).alias("linear")))
    return F.array_min(F.array(*found))


def fit_track(pos: DataFrame, ends: int = 5000, margin: float = 15.0) -> list[Edge]:
    """The three edges of a Z: between the corners of the extent of a recording's inner samples, ``margin`` further out.

    ``pos`` has a dense ``i``; the first and last ``ends`` samples don't count, unless there are no others.
    """
    n = pos.agg(F.max("i")).first()[0] or 0
    inner = pos.where(F.col("i").between(ends, n - ends)) if n > 2 * ends else pos
    x1, x2, y1, y2 = inner.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x1, x2, y1, y2 = x1 - margin, x2 + margin, y1 - margin, y2 + margin
    nodes = [(x1, y1), (x2, y1), (x1, y2), (x2, y2)]
    edges, base = [], 0.0
    for k, (a, b) in enumerate(zip(nodes, nodes[1:])):
        edges.append(Edge(k, *a, *b, base))
        base += math.dist(a, b)
    return edges


#: The monomials of a conic, in order of its coefficients.
_CONIC = ("xx", "xy", "yy", "x", "y", "one")


def fit_ellipse(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, n, cx, cy, major, minor, angle``: the ellipse of least algebraic distance, of half axes, in radians.

    Sums of products of the centred coordinates are grouped on Spark; the conic
    under the constraint of an ellipse is an eigenvector of a 3 by 3 matrix of them.
    Null where there is none, as with fewer than six points or all on a line.
    """
    known = points.where("x is not null and y is not null")
    means = known.groupBy(*keys).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("__u"))
    c = known.join(means, list(keys)) if keys else known.crossJoin(F.broadcast(means))
    u = F.when(F.col("__u") > 0, F.col("__u")).otherwise(1.0)
    x, y = (F.col("x") - F.col("__mx")) / u, (F.col("y") - F.col("__my")) / u
    terms = {"xx": x * x, "xy": x * y, "yy": y * y, "x": x, "y": y, "one": F.lit(1.0)}
    pairs = [(a, b) for k, a in enumerate(_CONIC) for b in _CONIC[k:]]
    sums = c.groupBy(*keys, "__mx", "__my", u.alias("__u")).agg(F.count("*").alias("n"), F.array(*[F.sum(terms[a] * terms[b]) for a, b in pairs]).alias("s"))

    @F.pandas_udf("cx double, cy double, major double, minor double, angle double")
    def solve(n: pd.Series, s: pd.Series, mx: pd.Series, my: pd.Series, u: pd.Series) -> pd.DataFrame:
        out = [_ellipse(k, np.asarray(v)) for k, v in zip(n, s)]
        rows = [(p * f + a, q * f + b, w * f, h * f, t) for (p, q, w, h, t), a, b, f in zip(out, mx, my, u)]
        return pd.DataFrame(rows, columns=["cx", "cy", "major", "minor", "angle"])

    found = sums.select(*keys, "n", solve("n", "s", "__mx", "__my", "__u").alias("e")).select(*keys, "n", "e.*")
    return found.select(*keys, "n", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("cx", "cy", "major", "minor", "angle")])


def _ellipse(n: int, sums: np.ndarray) -> tuple[float, ...]:
    none = (np.nan,) * 5
    s = np.zeros((6, 6))
    s[np.triu_indices(6)] = sums
    s = s + np.triu(s, 1).T
    quadratic, mixed, linear = s[:3, :3], s[:3, 3:], s[3:, 3:]
    if n < 6 or np.linalg.cond(linear) > 1e12:
        return none
    back = -np.linalg.solve(linear, mixed.T)
    m = quadratic + mixed @ back
    values, vectors = np.linalg.eig(np.array([m[2] / 2, -m[1], m[0] / 2]))
    vectors = np.real(vectors[:, np.abs(values.imag) < 1e-12])
    good = [v for v in vectors.T if 4 * v[0] * v[2] - v[1] ** 2 > 1e-15]
    if not good:
        return none
    a, b, c = good[0]
    d, e, f = back @ good[0]
    det = 4 * a * c - b * b
    cx, cy = (b * e - 2 * c * d) / det, (b * d - 2 * a * e) / det
    level = -(f + (d * cx + e * cy) / 2)
    sizes, axes = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]))
    half = level / sizes
    if not (half > 0).all():
        return none
    k = int(half.argmax())
    return cx, cy, math.sqrt(half[k]), math.sqrt(half[1 - k]), math.atan2(axes[1, k], axes[0, k]) % math.pi


def circled(x: Column, y: Column, ellipse: tuple[float, float, float, float, float]) -> tuple[Column, Column]:
    """Coordinates that make an ellipse (cx, cy, major, minor, angle) a circle of the same area about its centre."""
    cx, cy, major, minor, angle = ellipse
    c, s, r = math.cos(angle), math.sin(angle), math.sqrt(major * minor)
    along, across = ((x - cx) * c + (y - cy) * s) * (r / major), ((y - cy) * c - (x - cx) * s) * (r / minor)
    return along * c - across * s + cx, along * s + across * c + cy
