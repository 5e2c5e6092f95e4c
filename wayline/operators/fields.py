"""Fields and grid measures of maps.

A map is a group of bins of bounded number (its grid), so maps of cells, shifts
and trials are worked on side by side, each by a few numpy steps.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.shapes import Shape
from wayline.operators.tracking import _ellipse

ANGLES = (30, 60, 90, 120, 150)
#: The central peak of an autocorrelogram and its neighbours.
RING = 7


def _dense(rows: pd.DataFrame, y: str, x: str, v: str) -> tuple[np.ndarray, int, int]:
    """The map as an array with NaN where a bin is unknown, and the bin of its first cell."""
    y0, x0 = int(rows[y].min()), int(rows[x].min())
    a = np.full((int(rows[y].max()) - y0 + 1, int(rows[x].max()) - x0 + 1), np.nan)
    a[rows[y] - y0, rows[x] - x0] = rows[v].to_numpy(float)
    return a, y0, x0


def quantized(a: np.ndarray) -> np.ndarray:
    """Heights from 0 (the lowest bin) to 255 (the highest); an even map is 0."""
    low, high = float(a.min()), float(a.max())
    return ((a - low) * (255.0 / (high - low))).astype(int) if high > low else np.zeros(a.shape, int)


def _around(a: np.ndarray, edge: float) -> np.ndarray:
    """The largest of each bin's 3 x 3."""
    padded = np.pad(a, 1, constant_values=edge)
    return np.max([padded[dy : dy + a.shape[0], dx : dx + a.shape[1]] for dy in range(3) for dx in range(3)], axis=0)


def maxima(a: np.ndarray, least: float = 0) -> list[int]:
    """Flat indices of the regional maxima above ``least``; of bins that are equal and connected the last."""
    top = (a > least) & (_around(a, a.min() if a.size else 0) == a)
    return [int(k) for k in np.unique(components(top)) if k >= 0]


def flood(heights: np.ndarray, markers: list[int]) -> np.ndarray:
    """For each bin the marker (a flat index) whose water reaches it first; heights are 0 to 255.

    Water spreads from the markers over the four neighbours, always from the highest
    bin reached so far, of equal ones from the one reached first. So a plateau is
    shared by arrival. Bins reached wait in a queue for each height.
    """
    h, w = heights.shape
    level = heights.ravel().tolist()
    to, waiting = [-1] * (h * w), [[] for _ in range(256)]
    at, top = [0] * 256, -1
    for m in markers:
        to[m] = m
        waiting[level[m]].append(m)
        top = max(top, level[m])
    while top >= 0:
        if at[top] == len(waiting[top]):
            top -= 1
            continue
        k = waiting[top][at[top]]
        at[top] += 1
        y, x = divmod(k, w)
        for near, inside in ((k - w, y > 0), (k - 1, x > 0), (k + 1, x < w - 1), (k + w, y < h - 1)):
            if inside and to[near] < 0:
                to[near] = to[k]
                waiting[level[near]].append(near)
                top = max(top, level[near])
    return np.array(to).reshape(h, w)


def extents(a: np.ndarray, share: float, markers: list[int] | None = None) -> np.ndarray:
    """The maximum (or marker) whose flood reaches each bin of at least ``share`` of it, -1 elsewhere.

    Unknown bins count as 0; maxima of 0 or less have no extent.
    """
    v = np.nan_to_num(a)
    markers = maxima(v) if markers is None else markers
    if not markers:
        return np.full(a.shape, -1)
    to = flood(quantized(v), markers)
    return np.where(v >= share * v.ravel()[to], to, -1)


def filled(inside: np.ndarray) -> np.ndarray:
    """``inside`` with its holes: what no path over four neighbours leads to from the border."""
    out = np.pad(~inside, 1, constant_values=True)
    reached = np.zeros_like(out)
    reached[[0, -1], :], reached[:, [0, -1]] = True, True
    while True:
        more = reached.copy()
        more[1:] |= reached[:-1]
        more[:-1] |= reached[1:]
        more[:, 1:] |= reached[:, :-1]
        more[:, :-1] |= reached[:, 1:]
        more &= out
        if (more == reached).all():
            return ~reached[1:-1, 1:-1]
        reached = more


def components(inside: np.ndarray) -> np.ndarray:
    """For each bin where ``inside`` holds the last flat index of those it is connected with, over 8 neighbours; -1 elsewhere."""
    h, w = inside.shape
    to = np.where(inside, np.arange(inside.size).reshape(h, w), -1)
    while True:
        padded = np.pad(to, 1, constant_values=-1)
        top = np.max([padded[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
        after = np.where(inside, top, -1)
        if (after == to).all():
            return to
        to = after


def extent_of(a: np.ndarray, peak: tuple[int, int], share: float = 0.5, level: float | None = None) -> np.ndarray:
    """Whether each bin is connected with a peak by bins above ``share`` of it, or above a ``level``."""
    v = np.nan_to_num(a)
    of = components(v > (share * v[peak] if level is None else level))
    return (of == of[peak]) & (of >= 0)


#: Of 255, what the height of a field's peak is above.
LEAST_PEAK = 10


def find_fields(
    m: DataFrame,
    keys: tuple[str, ...],
    bin_cm: float,
    share: float = 0.5,
    least_cm2: float = 40.0,
    value: str = "rate",
    relative: tuple[int, float] | None = None,
    whole: bool = False,
    above: float | str | None = None,
) -> DataFrame:
    """``keys, gy, gx, rate, label``: the fields of each map; those below ``least_cm2`` go.

    A field is what the flood from a maximum reaches of at least ``share`` of that
    maximum; heights are told apart in 255 steps, and a maximum is above LEAST_PEAK of
    them. With ``whole`` it is what is connected above ``share`` of the map's
    largest rate; with ``above`` what is connected above that percentile of the
    known bins, or above their ``mean``, holes included. ``relative`` (k, x): fields
    below x of the k-th largest area (of the smallest, if there are fewer) go too.
    Labels count from 1 by falling peak, ties by later bin first.
    """
    names = list(keys)

    def joined(inside: np.ndarray, v: np.ndarray) -> np.ndarray:
        of = components(inside)
        peak = {int(p): int(max(np.flatnonzero(of.ravel() == p), key=lambda k: (v.ravel()[k], k))) for p in np.unique(of[of >= 0])}
        return np.vectorize(lambda p: peak.get(int(p), -1), otypes=[int])(of)

    def cut(a: np.ndarray) -> np.ndarray:
        v = np.nan_to_num(a)
        if above is not None:
            known = a[~np.isnan(a)]
            level = known.mean() if above == "mean" else np.percentile(known, above)
            return joined(filled(v > level), v)
        if whole:
            return joined(v > share * v.max(), v)
        top = v.max()
        steps = (v * 255.0 / top).astype(int) if top > 0 else np.zeros(v.shape, int)
        return extents(a, share, maxima(steps, LEAST_PEAK))

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        a, y0, x0 = _dense(rows, "gy", "gx", value)
        of, v = cut(a), np.nan_to_num(a).ravel()
        ids, n = np.unique(of[of >= 0], return_counts=True)
        least = least_cm2 / bin_cm**2
        if relative and (n >= least).any():
            areas = sorted(n[n >= least], reverse=True)
            least = max(least, relative[1] * areas[min(relative[0], len(areas)) - 1])
        large = sorted((int(p) for p, c in zip(ids, n) if c >= least), key=lambda p: (-v[p], -p))
        number = {p: k + 1 for k, p in enumerate(large)}
        at = of[rows["gy"] - y0, rows["gx"] - x0]
        out = rows[[*names, "gy", "gx", value]].assign(label=[number.get(int(p), 0) for p in at])
        return out[out["label"] > 0]

    part = m.select(*keys, "gy", "gx", F.col(value).cast("double").alias(value))
    types = ", ".join(f"{k} {part.schema[k].dataType.simpleString()}" for k in part.columns)
    return part.groupBy(*keys).applyInPandas(label, types + ", label int")


def crop(found: DataFrame, shape: Shape, height: float, width: float, bin_cm: float) -> DataFrame:
    """``found`` without bins outside of an arena's shape or beside such a bin."""
    grid = shape.mask(found.sparkSession, height, width, bin_cm)
    beside = [F.struct((F.col("gy") + dy).alias("gy"), (F.col("gx") + dx).alias("gx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    out = grid.where("outside").select(F.inline(F.array(*beside))).distinct()
    return found.join(F.broadcast(out), ["gy", "gx"], "left_anti")  # as many rows as the arena has bins


def sampled(a: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> np.ndarray:
    """``a`` at the places ``sy, sx``, bilinear; NaN where that needs an unknown bin."""
    h, w = a.shape
    sy, sx = np.round(sy, 9), np.round(sx, 9)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    out = np.zeros(sy.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            weight = np.where(dy, sy - y0, 1 - sy + y0) * np.where(dx, sx - x0, 1 - sx + x0)
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            v = np.where(inside, a[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], np.nan)
            out += np.where(weight > 0, weight * v, 0.0)
    return out


def transformed(a: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The map in which what lies at ``p`` from the middle has moved to ``matrix @ p`` (y, x)."""
    h, w = a.shape
    cy, cx = (h - 1) / 2, (w - 1) / 2
    y, x = np.mgrid[:h, :w]
    back = np.linalg.inv(matrix)
    return sampled(a, back[0, 0] * (y - cy) + back[0, 1] * (x - cx) + cy, back[1, 0] * (y - cy) + back[1, 1] * (x - cx) + cx)


def rotated(a: np.ndarray, degrees: float) -> np.ndarray:
    """``a`` turned about its middle, bilinear; NaN where that needs an unknown bin."""
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    return transformed(a, np.array([[c, -s], [s, c]]))


def _correlate(a: np.ndarray, b: np.ndarray) -> float:
    ok = ~(np.isnan(a) | np.isnan(b))
    x, y = a[ok] - a[ok].mean() if ok.any() else a[ok], b[ok] - b[ok].mean() if ok.any() else b[ok]
    d = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / d) if d > 0 else np.nan


def _ring(a: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Each bin's field, the central maximum and those nearest it, and each bin's distance from the middle."""
    c = np.array(a.shape) // 2
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    dist = np.hypot(y - c[0], x - c[1])
    v = np.nan_to_num(a)
    peaks = maxima(v)
    return extents(a, 0.5, peaks), sorted(peaks, key=lambda p: (round(dist.ravel()[p], 9), p))[:RING], dist


def circling(a: np.ndarray) -> np.ndarray | None:
    """The map (y, x) that turns the ellipse through the six maxima around the central one into a circle of its area; None without one."""
    _, near, _ = _ring(a)
    if len(near) < RING:
        return None
    y, x = np.divmod(np.array(near[1:]), a.shape[1]) - np.array(a.shape)[:, None] // 2
    terms = np.stack([x * x, x * y, y * y, x, y, np.ones(len(x))]).astype(float)
    scale = max(1.0, float(np.abs(terms[3:5]).max()))
    terms /= np.array([scale**2, scale**2, scale**2, scale, scale, 1])[:, None]
    *_, major, minor, angle = _ellipse(len(x), (terms @ terms.T)[np.triu_indices(6)])
    if not (major > 0 and minor > 0):
        return None
    along = np.array([np.sin(angle), np.cos(angle)])
    across = np.array([np.cos(angle), -np.sin(angle)])
    r = math.sqrt(major * minor)
    return r / major * np.outer(along, along) + r / minor * np.outer(across, across)


def _orientation(y: np.ndarray, x: np.ndarray, mode: str) -> float:
    angle = np.arctan2(y, -x)
    if mode == "first":
        return float(np.degrees(angle[angle > 0].min())) if (angle > 0).any() else np.nan
    return float(np.degrees(np.angle(np.exp(6j * angle).mean())) / 6 % 60)


def measures(a: np.ndarray, bin_cm: float, orientation: str = "mean", ellipse: bool = False) -> dict[str, float]:
    """Of an autocorrelogram with offset 0 in the middle: ``n_peaks, scale, orientation, gridness, stretch``.

    The six maxima nearest the central one give the median distance and the
    orientation in degrees: the mean angle modulo 60, or the ``first`` from 0 on.
    Gridness compares the ring they lie in, as far out as their half-height fields
    reach and without the central field, with itself turned: the smaller of 60 and
    120 degrees less the largest of 30, 90 and 150.

    ``ellipse``: before that the map is stretched so that the ellipse through the
    six becomes a circle; as they move with it, that is done until they lie on one
    (three times at most, each from the map as it was). ``stretch`` is the ratio of
    its axes, 1 where nothing was done.
    """
    warp = np.eye(2)
    for _ in range(3 if ellipse else 0):
        more = circling(transformed(a, warp))
        if more is None:
            break
        warp = more @ warp
        if np.abs(more - np.eye(2)).max() < 0.01:
            break
    sizes = np.linalg.svd(warp, compute_uv=False)
    if sizes[0] > sizes[1]:
        a = transformed(a, warp)
    c = np.array(a.shape) // 2
    of, near, dist = _ring(a)
    out = {"n_peaks": len(near), "scale": np.nan, "orientation": np.nan, "gridness": np.nan, "stretch": float(sizes[0] / sizes[1])}
    if len(near) < 2:
        return out
    ring = np.array(near[1:])
    y, x = np.divmod(ring, a.shape[1])
    out["scale"] = float(np.median(dist.ravel()[ring]) * bin_cm)
    out["orientation"] = _orientation(y - c[0], x - c[1], orientation)
    far = dist[np.isin(of, near)].max() if len(near) == RING else np.inf
    radius = min(far, float(min(c)))
    annulus = np.where((dist <= radius) & (of != of[c[0], c[1]]), a, np.nan)
    w = int(np.ceil(radius))
    annulus = annulus[max(c[0] - w, 0) : c[0] + w + 1, max(c[1] - w, 0) : c[1] + w + 1]
    r = {d: _correlate(annulus, rotated(annulus, d)) for d in ANGLES}
    out["gridness"] = min(r[60], r[120]) - max(r[30], r[90], r[150])
    return out


def grid_measures(ac: DataFrame, keys: tuple[str, ...], bin_cm: float, orientation: str = "mean", ellipse: bool = False) -> DataFrame:
    """``keys, n_peaks, scale, orientation, gridness`` of autocorrelograms ``keys, dy, dx, r``, and ``stretch`` with ``ellipse``; null where not defined."""
    names = list(keys)

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        half = np.abs(rows[["dy", "dx"]]).max().to_numpy(int)
        a = np.full((2 * half[0] + 1, 2 * half[1] + 1), np.nan)
        a[rows["dy"] + half[0], rows["dx"] + half[1]] = rows["r"].to_numpy(float)
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in names}, **measures(a, bin_cm, orientation, ellipse)}])

    part = ac.select(*keys, "dy", "dx", F.col("r").cast("double").alias("r"))
    types = "".join(f"{k} {part.schema[k].dataType.simpleString()}, " for k in names)
    found = part.groupBy(*keys).applyInPandas(measure, types + "n_peaks int, scale double, orientation double, gridness double, stretch double")
    shown = ("scale", "orientation", "gridness", *(["stretch"] if ellipse else []))
    return found.select(*keys, "n_peaks", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in shown])


def circular_shifts(spikes: DataFrame, n_pos: Column | int, shifts: list[int]) -> DataFrame:
    """``spikes`` once for each ``shift``, with ``pos_i`` moved on by it around the recording."""
    n = n_pos if isinstance(n_pos, Column) else F.lit(n_pos)
    moved = spikes.select("*", F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift"))
    return moved.withColumn("pos_i", F.pmod(F.col("pos_i") + F.col("shift"), n))


def random_shifts(n: int, count: int, least: int, seed: int = 0) -> list[int]:
    """``count`` shifts around ``n`` samples, each ``least`` or more from none at all (a third of them, if there are few)."""
    least = min(least, n // 3)
    whole = max(1, n - 2 * least + 1)
    return [least + int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:12], 16) % whole for k in range(count)]


def field_areas(found: DataFrame, keys: tuple[str, ...], bin_cm: float) -> DataFrame:
    """``keys, label, area, cy, cx``: area in square cm and rate-weighted centre in cm of each field."""
    r, at = F.col("rate"), lambda c: (F.sum(F.col("rate") * (F.col(c) + 0.5)) / F.sum("rate") * bin_cm)
    return found.where(r.isNotNull()).groupBy(*keys, "label").agg((F.count("*") * bin_cm**2).alias("area"), at("gy").alias("cy"), at("gx").alias("cx"))


def area_summary(areas: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, n, median_area, mean_area, geomean_area`` over a map's fields."""
    a = F.col("area").cast("double")
    return areas.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(a, F.lit(0.5)).alias("median_area"), F.avg(a).alias("mean_area"), F.exp(F.avg(F.log(a))).alias("geomean_area"))


def field_triangles(areas: DataFrame, keys: tuple[str, ...], tolerance: float = 15.0, relative: tuple[int, float] = (2, 0.6)) -> DataFrame:
    """``keys, a, b, c, area, side``: triangles of neighbouring field centres that are nearly equilateral.

    Neighbours are the corners of a triangle whose circumscribed circle holds no
    other centre. All angles must be within ``tolerance`` of 60 degrees, and the
    area at least a share of the k-th largest of those. ``side`` is the mean side.
    A map has few fields.
    """
    names = list(keys)

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("label")
        p, label = rows[["cx", "cy"]].to_numpy(float), rows["label"].to_numpy()
        out = []
        for a, b, c in combinations(range(len(p)), 3):
            u, v = p[b] - p[a], p[c] - p[a]
            area = abs(u[0] * v[1] - u[1] * v[0]) / 2
            sides = np.array([np.linalg.norm(p[b] - p[c]), np.linalg.norm(v), np.linalg.norm(u)])
            if area <= 1e-9 * sides.max() ** 2:
                continue
            squares = sides**2
            cosines = (squares.sum() - 2 * squares) / (2 * sides.prod() / sides)
            if (np.abs(np.degrees(np.arccos(np.clip(cosines, -1, 1))) - 60) > tolerance).any():
                continue
            centre = p[a] + np.linalg.solve(2 * np.array([u, v]), [u @ u, v @ v])
            r = np.linalg.norm(p[a] - centre)
            others = np.delete(p, [a, b, c], axis=0)
            if len(others) and (np.linalg.norm(others - centre, axis=1) < r * (1 - 1e-9)).any():
                continue
            out.append((label[a], label[b], label[c], area, sides.mean()))
        made = pd.DataFrame(out, columns=["a", "b", "c", "area", "side"])
        if len(made):
            large = made["area"].sort_values(ascending=False).to_numpy()
            made = made[made["area"] >= relative[1] * large[min(relative[0], len(large)) - 1]]
        return made.assign(**{k: rows[k].iloc[0] for k in names})[[*names, *made.columns]]

    part = areas.select(*keys, F.col("label").cast("int").alias("label"), "cx", "cy")
    types = "".join(f"{k} {part.schema[k].dataType.simpleString()}, " for k in names)
    return part.groupBy(*keys).applyInPandas(find, types + "a int, b int, c int, area double, side double")


def crossings(x: np.ndarray, level: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Where a short series crosses a level, upwards and downwards, interpolated between samples."""
    a, b = x[:-1], x[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.arange(len(a)) + (level - a) / (b - a)
    return at[(a < level) & (b >= level)], at[(a > level) & (b <= level)]


def line_autocorrelation_properties(
    ac: DataFrame, mean_rate: float, size: float = 1.0, most: float = 100.0, least: float = 5.0, smoothing: float = 31.0, level: float = 0.01, around: float = 5.0, keys: tuple[str, ...] = ()
) -> DataFrame:
    """``keys, scale, trough, clusteriness, width`` of a radial autocorrelogram ``keys, d, rate``, up to ``most`` cm.

    On the slope of a sliding parabola, in units of the mean rate for each sample:
    the first fall after ``least`` cm ends at ``trough``, the next rise at ``scale``.
    ``width`` is what lies between the last rise above ``level`` before the scale
    and the first fall below it after, by the scale; ``clusteriness`` where a line
    through the inner peak's flank is half as high as its top, by the scale. Null
    where there is no such place. An autocorrelogram is one short series.
    """
    names = list(keys)
    n, first, near = math.ceil(most / size), math.floor(least / size), math.ceil(around / size)
    window = math.ceil(smoothing / size) | 1
    taps = np.linalg.pinv(np.vander(np.arange(window) - window // 2.0, 3, increasing=True))[1]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(n)
        short = rows[(rows["d"] < n) & rows["rate"].notna()]
        a[short["d"]] = short["rate"] / mean_rate
        slope = np.convolve(np.pad(a, window // 2, mode="reflect"), taps[::-1], "valid") if n > window // 2 else np.zeros(n)
        out = dict.fromkeys(("scale", "trough", "clusteriness", "width"), np.nan)
        ups, downs = crossings(slope[first:])
        if len(ups):
            trough = out["trough"] = ups[0] + first
            later = downs[downs > ups[0]]
            if len(later):
                scale = out["scale"] = later[0] + first
                before = crossings(slope[: math.ceil(scale) + 1], level)[0]
                after = crossings(slope[max(0, math.floor(scale) - 1) :], -level)[1] + max(0, math.floor(scale) - 1)
                if len(before) and len(after):
                    out["width"] = (after[0] - before[-1]) / scale
                top, low = a[1:near].mean(), a[max(0, int(trough) - math.ceil(near / 2)) : int(trough + math.ceil(near / 2))].mean()
                falls = [crossings(a[: int(trough)], low + (top - low) * x)[1] for x in (0.9, 0.1)]
                if len(falls[0]) and len(falls[1]):
                    x = np.arange(math.ceil(falls[0][-1]), math.ceil(falls[1][0]))
                    if len(x) > 1:
                        k, c = np.polyfit(x, a[x], 1)
                        out["clusteriness"] = ((top + low) / 2 - c) / k / scale
        made = {**{c: rows[c].iloc[0] for c in names}, **out, "scale": out["scale"] * size, "trough": out["trough"] * size}
        return pd.DataFrame([made])

    part = ac.select(*keys, F.col("d").cast("int").alias("d"), F.col("rate").cast("double").alias("rate"))
    types = "".join(f"{c} {part.schema[c].dataType.simpleString()}, " for c in names)
    found = part.groupBy(*keys).applyInPandas(one, types + "scale double, trough double, clusteriness double, width double")
    return found.select(*keys, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("scale", "trough", "clusteriness", "width")])
