"""Fits of triangular lattices, and shifts between maps.

Parameters that a fit tries are keys, so they are tried side by side. What a task
holds is a table of tiles or one map, of bounded size, never the samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Height of a row of a triangular lattice, for a distance of 1 between its points.
ROW = math.sqrt(3) / 2


def ideal_tile(n: int) -> np.ndarray:
    """One unit of a lattice, axis by axis, at bin centres: three waves 60 degrees apart, below 0 cut off, of mean 1."""
    u, v = np.meshgrid((np.arange(n) + 0.5) / n, (np.arange(n) + 0.5) / n)
    tile = np.maximum(sum(np.cos(2 * math.pi * w) for w in (u, v, u + v)), 0)
    return tile / tile.mean()


#: Cells whose tiles a task holds at once, 20 MB each; those of more are sent on in parts.
HELD = 8


def fit_ideal_grid(
    samples: DataFrame, scales: list[float] | None = None, orientations: list[float] | None = None, n: int = 32, keys: tuple[str, ...] = ()
) -> DataFrame:
    """``keys, orientation, scale, offset_u, offset_v, pearson``: the lattice that fits a cell best.

    ``samples`` has ``keys, x, y, spk``, the cell's spikes at each sample. For each
    orientation (degrees by which turning the points brings an axis of the lattice
    to x) and scale the samples are folded into a unit tile of ``n`` by ``n`` bins,
    whose rates, 0 where no sample fell, are correlated with an ideal tile at all
    shifts. Ties go to the smaller orientation, then scale, then shift. Samples are
    folded where they lie; only tiles of counts, 8 kB for each orientation and
    scale, are exchanged.
    """
    if n < 2 or n & (n - 1):
        raise ValueError("the tile's side must be a power of 2")
    scale = np.linspace(28, 58, 20) if scales is None else np.asarray(scales, float)
    angle = np.linspace(0, 60, 60, endpoint=False) if orientations is None else np.asarray(orientations, float)
    names, size = list(keys), n * n
    part = samples.where("x is not null and y is not null").select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("spk").cast("double").alias("spk"))
    types = "".join(f"{k} {part.schema[k].dataType.simpleString()}, " for k in names)

    def let_go(held: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
        for key, tiles in held.items():
            made = {k: [v] * len(angle) for k, v in zip(names, key if isinstance(key, tuple) else (key,))}
            yield pd.DataFrame({**made, "a": np.arange(len(angle), dtype=np.int32), "tiles": [t.tobytes() for t in tiles]})
        held.clear()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, rows in b.groupby(names, dropna=False) if names else [((), b)]:
                if key not in held and len(held) >= HELD:
                    yield from let_go(held)
                tiles = held.setdefault(key, np.zeros((len(angle), 2, len(scale) * size)))
                x, y, spk = (rows[c].to_numpy() for c in ("x", "y", "spk"))
                fired = np.flatnonzero(spk)
                for a, t in enumerate(np.deg2rad(angle)):
                    rx, ry = x * math.cos(t) - y * math.sin(t), x * math.sin(t) + y * math.cos(t)
                    u, v = rx - ry / (2 * ROW), ry / ROW
                    bu, bv = (np.floor(w[None, :] * (n / scale[:, None])).astype(np.int64) & (n - 1) for w in (u, v))
                    at = bv * n + bu + (np.arange(len(scale)) * size)[:, None]
                    tiles[a, 0] += np.bincount(at.ravel(), minlength=len(scale) * size)
                    tiles[a, 1] += np.bincount(at[:, fired].ravel(), np.tile(spk[fired], len(scale)), len(scale) * size)
        yield from let_go(held)

    ideal = ideal_tile(n)
    f_ideal, s_ideal, ss_ideal = np.conj(np.fft.fft2(ideal)), ideal.sum(), (ideal**2).sum()

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((2, len(scale), n, n))
        for blob in rows["tiles"]:
            total += np.frombuffer(blob).reshape(total.shape)
        rate = np.divide(total[1], total[0], out=np.zeros_like(total[1]), where=total[0] > 0)
        cross = np.fft.ifft2(np.fft.fft2(rate) * f_ideal).real
        s, ss = rate.sum((1, 2), keepdims=True), (rate**2).sum((1, 2), keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (cross * size - s * s_ideal) / (np.sqrt(size * ss - s**2) * math.sqrt(size * ss_ideal - s_ideal**2))
        r = np.round(np.nan_to_num(r, nan=-1.0), 12)
        k, v, u = np.unravel_index(r.argmax(), r.shape)
        a = int(rows["a"].iloc[0])
        return pd.DataFrame([{**{c: rows[c].iloc[0] for c in names}, "orientation": angle[a], "scale": scale[k], "offset_u": u / n, "offset_v": v / n, "pearson": r[k, v, u]}])

    folded = part.mapInPandas(fold, types + "a int, tiles binary")
    fits = folded.groupBy(*keys, "a").applyInPandas(match, types + "orientation double, scale double, offset_u double, offset_v double, pearson double")
    best = F.min(F.struct((-F.col("pearson")).alias("p"), "orientation", "scale", "offset_u", "offset_v")).alias("b")
    return fits.groupBy(*keys).agg(best).select(*keys, "b.orientation", "b.scale", "b.offset_u", "b.offset_v", (-F.col("b.p")).alias("pearson"))


# -- lattices of points --------------------------------------------------------


def turned(x: Column, y: Column, orient: Column) -> tuple[Column, Column]:
    """Coordinates along and across the rows of a lattice whose rows run at ``orient``; rows are 1 apart for a scale of 1."""
    along = x * F.cos(orient) + y * F.sin(orient)
    return along, (y * F.cos(orient) - x * F.sin(orient)) / ROW


def lattice_distance(x: Column, y: Column, orient: Column, scale: Column, u: Column, v: Column) -> Column:
    """Squared distance to the nearest point of a triangular lattice.

    Points of a row are ``scale`` apart, every other row is shifted by half of it;
    ``u`` and ``v`` shift the lattice by shares of that along rows and of a row across.
    """
    along, across = turned(x, y, orient)
    p, q = along / scale - u, across / scale - v
    row = F.floor(q)

    def to(k: Column) -> Column:
        dx = p - F.lit(0.5) * F.pmod(k, F.lit(2))
        dx, dy = dx - F.round(dx), (q - k) * ROW
        return dx * dx + dy * dy

    return F.least(to(row), to(row + 1)) * scale * scale


def lattice_points(spark, orient: float, scale: float, u: float, v: float, low: float, high: float) -> DataFrame:
    """``x, y`` of a lattice's points between ``low`` and ``high`` on both axes, ends excluded."""
    m = int(math.ceil(2 * max(abs(low), abs(high)) / scale / ROW)) + 2
    side = 2 * m + 1
    at = spark.range(side * side).select((F.col("id") % side - m).alias("a"), (F.floor(F.col("id") / side) - m).alias("k"))
    p, q = (F.col("a") + 0.5 * F.pmod("k", F.lit(2)) + u) * scale, (F.col("k") + v) * (ROW * scale)
    c, s = math.cos(orient), math.sin(orient)
    both = at.select((p * c - q * s).alias("x"), (p * s + q * c).alias("y"))
    inside = lambda w: (F.col(w) > low) & (F.col(w) < high)
    return both.where(inside("x") & inside("y"))


def fit_lattice(peaks: DataFrame, orients: int, scales: list[float], phases: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, cost, orient, scale, u, v``: the lattice with the least weighted squared distance of a map's peaks to it.

    ``peaks`` has ``keys, x, y, w``, of one map a bounded number. Orientations
    divide 60 degrees, phases a row's period (and, by the rows' height, what lies
    across); without them the lattice has a point at 0. Ties go to the smaller
    orientation, scale and phase.
    """
    spark = peaks.sparkSession
    across = [0.0] if phases is None else [k / int(phases * ROW) for k in range(int(phases * ROW))]
    along = [0.0] if phases is None else [k / phases for k in range(phases)]
    lists = [[k * math.pi / 3 / orients for k in range(orients)], list(map(float, scales)), along, across]
    tried = spark.range(math.prod(map(len, lists)))
    rest = F.col("id")
    for name, some in zip(("orient", "scale", "u", "v"), lists):
        tried = tried.withColumn(name, F.element_at(F.array(*map(F.lit, some)), (rest % len(some) + 1).cast("int")))
        rest = F.floor(rest / len(some))
    points = peaks.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "w")).alias("points"))
    both = tried.crossJoin(F.broadcast(points)) if not keys else points.crossJoin(F.broadcast(tried))  # one row; as many as are tried
    d = lambda p: lattice_distance(p["x"], p["y"], F.col("orient"), F.col("scale"), F.col("u"), F.col("v"))
    cost = F.aggregate("points", F.lit(0.0), lambda a, p: a + d(p) * p["w"])
    best = both.groupBy(*keys).agg(F.min(F.struct(F.round(cost, 9).alias("cost"), "orient", "scale", "u", "v")).alias("b"))
    return best.select(*keys, "b.*")


# -- shifts between maps -------------------------------------------------------


def _soft(a: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(lambda line: np.convolve(line, w)[r : r + len(line)], axis, a)
    return a


def warp(first: DataFrame, second: DataFrame, most: int = 6, sigma: float = 8.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, gy, gx, dy, dx, r``: by how many bins the surroundings of each bin are best moved to find them in the other map.

    A bin's surroundings are weighted by a Gaussian of ``sigma`` bins; ``r`` is
    their weighted correlation with those of the bin at (gy - dy, gx - dx) of
    ``second``, over bins known in both. Ties go to the smaller dy, then dx; bins
    without a defined correlation are left out. One pair of maps is one group.
    """
    names = list(keys)
    a = first.select(*keys, "gy", "gx", F.col("rate").cast("double").alias("rate"), F.lit(0).alias("side"))
    both = a.unionByName(second.select(*keys, "gy", "gx", F.col("rate").cast("double").alias("rate"), F.lit(1).alias("side")))

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["gy"].to_numpy(), rows["gx"].to_numpy()
        m = np.full((2, y.max() - y.min() + 1, x.max() - x.min() + 1), np.nan)
        m[rows["side"], y - y.min(), x - x.min()] = rows["rate"].to_numpy()
        h, w = m.shape[1:]
        top, at = np.full((h, w), -np.inf), np.zeros((2, h, w), int)
        for dy in range(-most, most + 1):
            for dx in range(-most, most + 1):
                if abs(dy) >= h or abs(dx) >= w:
                    continue
                here = np.s_[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
                there = np.s_[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
                p, q = m[0][here], m[1][there]
                ok = ~(np.isnan(p) | np.isnan(q))
                p, q = np.where(ok, p, 0), np.where(ok, q, 0)
                n, sp, sq, spp, sqq, spq = (_soft(t, sigma) for t in (ok.astype(float), p, q, p * p, q * q, p * q))
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = (n * spq - sp * sq) / np.sqrt((n * spp - sp**2) * (n * sqq - sq**2))
                better = np.round(np.nan_to_num(r, nan=-np.inf), 12) > top[here]
                top[here][better] = np.round(r[better], 12)
                at[0][here][better], at[1][here][better] = dy, dx
        gy, gx = np.nonzero(np.isfinite(top))
        made = {k: [rows[k].iloc[0]] * len(gy) for k in names}
        return pd.DataFrame({**made, "gy": gy + y.min(), "gx": gx + x.min(), "dy": at[0][gy, gx], "dx": at[1][gy, gx], "r": top[gy, gx]})

    types = "".join(f"{k} {both.schema[k].dataType.simpleString()}, " for k in names)
    return both.groupBy(*keys).applyInPandas(best, types + "gy int, gx int, dy int, dx int, r double")


def warp_summary(warped: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, n, mean_dy, mean_dx, mean_size, mean_r`` of a map of shifts."""
    size = F.hypot("dy", "dx")
    return warped.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("dy").alias("mean_dy"), F.avg("dx").alias("mean_dx"), F.avg(size).alias("mean_size"), F.avg("r").alias("mean_r"))


def drift_likelihood(samples: DataFrame, m: DataFrame, shape: tuple[int, int], most: int = 8) -> DataFrame:
    """``run, dy, dx, ll``: Poisson log likelihood of each run if the map had lain ``dy, dx`` bins off, without the term of the counts alone.

    ``samples`` has ``run, gy, gx, k`` (spikes at the sample); ``m`` a rate in
    spikes a sample for every bin, none of them 0 or null. Bins beyond the border
    count as those at it. Equal bins of a run are counted before they are shifted.
    """
    counted = samples.groupBy("run", "gy", "gx").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    spark = samples.sparkSession
    side = 2 * most + 1
    moves = spark.range(side * side).select((F.floor(F.col("id") / side) - most).cast("int").alias("dy"), (F.col("id") % side - most).cast("int").alias("dx"))
    clip = lambda c, d, n: F.greatest(F.least(F.col(c) + F.col(d), F.lit(n - 1)), F.lit(0))
    moved = counted.crossJoin(F.broadcast(moves)).select("run", "dy", "dx", "n", "k", clip("gy", "dy", shape[0]).alias("gy"), clip("gx", "dx", shape[1]).alias("gx"))
    met = moved.join(F.broadcast(m.select("gy", "gx", "rate")), ["gy", "gx"])  # as many rows as bins
    return met.groupBy("run", "dy", "dx").agg(F.sum(F.col("k") * F.log("rate") - F.col("n") * F.col("rate")).alias("ll"))


def drift(ll: DataFrame, mode: str = "peak") -> DataFrame:
    """``run, dy, dx, p`` from :func:`drift_likelihood`: each run's shift and its share of the likelihood.

    ``mean`` is the centre of mass (``p`` is null); ``peak`` the local maximum
    nearest to 0 that nothing as near exceeds, ties to the smaller dy, then dx;
    runs without one are null. A run has one row for each shift, a bounded number.
    """
    top = ll.groupBy("run").agg(F.max("ll").alias("__top"))
    # equal but for rounding is equal
    share = ll.join(top, "run").withColumn("g", F.round(F.col("ll") - F.col("__top"), 6)).withColumn("w", F.exp("g"))
    if mode == "mean":
        mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
        return share.groupBy("run").agg(mean("dy"), mean("dx"), F.lit(None).cast("double").alias("p"))

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        most = int(rows["dy"].max())
        g = np.full((2 * most + 1, 2 * most + 1), -np.inf)
        g[rows["dy"] + most, rows["dx"] + most] = rows["g"]
        padded, w = np.pad(g, 1, constant_values=-np.inf), np.exp(g)
        around = np.max([padded[a : a + len(g), b : b + len(g)] for a in range(3) for b in range(3)], axis=0)
        y, x = np.mgrid[-most : most + 1, -most : most + 1]
        d = (y * y + x * x).ravel()
        order = np.argsort(d, kind="stable")
        reach = np.searchsorted(d[order], d, side="right") - 1
        below = np.maximum.accumulate(g.ravel()[order])[reach]
        good = ((around == g).ravel() & np.isfinite(g.ravel()) & (g.ravel() >= below))[order]
        if not good.any():
            return pd.DataFrame([{"run": rows["run"].iloc[0], "dy": None, "dx": None, "p": None}])
        k = order[good.argmax()]
        return pd.DataFrame([{"run": rows["run"].iloc[0], "dy": float(y.ravel()[k]), "dx": float(x.ravel()[k]), "p": w.ravel()[k] / w.sum()}])

    run_type = ll.schema["run"].dataType.simpleString()
    return share.select("run", "dy", "dx", "g").groupBy("run").applyInPandas(nearest, f"run {run_type}, dy double, dx double, p double")


def drift_summary(found: DataFrame) -> DataFrame:
    """``n, mean_dy, mean_dx, std_dy, std_dx`` over runs."""
    each = [f(c).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("std", F.stddev_pop)) for c in ("dy", "dx")]
    return found.agg(F.count("dy").alias("n"), *each)
