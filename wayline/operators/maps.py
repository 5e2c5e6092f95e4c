"""Operators on maps: autocorrelation, stability, coherence, maxima, centroids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.circular import correlation, ratio


def _corr(df: DataFrame, keys: list, a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col(a), F.col(b)).alias("r"))


def autocorrelation(m: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, dy, dx, n, r``: correlation of a map with itself at each offset where two known bins or more overlap.

    One map is one group, of bounded size; all offsets' sums come from its Fourier
    transforms. ``r`` is null where a side has no variance (below 1e-10 of the map's).
    """
    names = list(keys)

    def correlate(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["rate"].notna()]
        if rows.empty:
            return pd.DataFrame({**{k: [] for k in names}, "dy": [], "dx": [], "n": [], "r": []})
        y, x, v = (rows[c].to_numpy() for c in ("gy", "gx", "rate"))
        h, w = int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1
        ones, a = np.zeros((h, w)), np.zeros((h, w))
        scale = v.std() or 1.0
        ones[y - y.min(), x - x.min()] = 1
        a[y - y.min(), x - x.min()] = (v - v.mean()) / scale  # centred, so that little cancels
        size = [1 << (2 * k - 1).bit_length() for k in (h, w)]
        f1, fa, faa = (np.fft.rfft2(t, size) for t in (ones, a, a * a))
        lag = lambda p, q: np.roll(np.fft.irfft2(np.conj(p) * q, size), (h - 1, w - 1), (0, 1))[: 2 * h - 1, : 2 * w - 1]
        n = np.rint(lag(f1, f1))
        sa, sb, saa, sbb, sab = lag(fa, f1), lag(f1, fa), lag(faa, f1), lag(f1, faa), lag(fa, fa)
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb = saa - sa * sa / n, sbb - sb * sb / n
            r = (sab - sa * sb / n) / np.sqrt(va * vb)
        r[~((va > 1e-10) & (vb > 1e-10))] = np.nan
        dy, dx = np.nonzero(n > 1)
        made = {k: [rows[k].iloc[0]] * len(dy) for k in names}
        return pd.DataFrame({**made, "dy": dy - h + 1, "dx": dx - w + 1, "n": n[dy, dx].astype(np.int64), "r": np.clip(r[dy, dx], -1, 1)})

    part = m.select(*keys, F.col("gy").cast("int").alias("gy"), F.col("gx").cast("int").alias("gx"), F.col("rate").cast("double").alias("rate"))
    types = [f"{k} {part.schema[k].dataType.simpleString()}" for k in keys]
    out = part.groupBy(*keys).applyInPandas(correlate, ", ".join([*types, "dy int, dx int, n bigint, r double"]))
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def windowed_autocorrelation(
    spikes: DataFrame, pos: DataFrame, window: int, step: int, size: float, extent: tuple[float, float], smooth: int = 5, least: int = 100, keys: tuple[str, ...] = (), radial: bool = False
) -> DataFrame:
    """``keys, dy, dx, rate`` (``keys, d, rate`` if ``radial``): how often a cell fires again, by displacement since a spike.

    Of the samples up to ``window`` before and after a spike every ``step``-th
    gives a displacement of dwell; later spikes of the cell within the window one
    of spikes, which counts for both directions. Displacements are rounded to bins
    of ``size``, up to the arena's ``extent`` (height, width). Bins with ``least``
    samples or fewer are null; both counts are smoothed by a boxcar of ``smooth``
    bins that repeats the border. A spike meets the samples of the window's own and
    next stretch of the recording; pairs are counted where they are made.
    """
    names = list(keys)
    last = pos.agg(F.max("i").alias("__last"))
    width = 2 * window + 1
    fired = spikes.select(*keys, F.col("pos_i").alias("a")).withColumn("s", F.monotonically_increasing_id())
    fired = fired.join(pos.select(F.col("i").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), "a").crossJoin(F.broadcast(last))
    low, high = F.greatest(F.col("a") - window, F.lit(0)), F.least(F.col("a") + window + 1, F.col("__last"))
    fired = fired.where("ax is not null and ay is not null").select(*keys, "s", "a", "ax", "ay", low.alias("low"), high.alias("high"))
    near = fired.withColumn("__b", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    dy, dx = (F.col("y") - F.col("ay")) / size, (F.col("x") - F.col("ax")) / size
    if radial:
        by = [F.floor(F.hypot(dy, dx) + 0.5).cast("int").alias("d")]
    else:
        by = [F.floor(d + 0.5).cast("int").alias(n) for d, n in ((dy, "dy"), (dx, "dx"))]
    place = [c for c in (["d"] if radial else ["dy", "dx"])]
    at = pos.where("x is not null and y is not null").select("i", "x", "y", F.floor(F.col("i") / width).alias("__b"))
    inside = (F.col("i") >= F.col("low")) & (F.col("i") < F.col("high"))
    dwell = near.join(at, "__b").where(inside & ((F.col("i") - F.col("low")) % step == 0)).groupBy(*keys, *by).agg(F.count("*").cast("double").alias("dwell"))
    again = fired.select(*keys, F.col("s").alias("t"), F.col("a").alias("i"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.floor(F.col("a") / width).alias("__b"))
    later = (F.col("i") > F.col("a")) | (F.col("i") == F.col("a")) & (F.col("t") > F.col("s"))
    pairs = near.join(again, [*names, "__b"]).where(later & (F.col("i") < F.col("high")))
    spk = pairs.groupBy(*keys, *by).agg(F.count("*").cast("double").alias("spk"))
    half = (math.ceil(math.hypot(*extent) / size),) if radial else tuple(math.ceil(e / size) for e in extent)

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        shape = tuple(2 * h + 1 for h in half)
        both = np.zeros((2, *shape))
        index = tuple(rows[c].to_numpy() + (0 if radial else h) for c, h in zip(place, half))
        for k, c in enumerate(("dwell", "spk")):
            np.add.at(both[k], index, rows[c].fillna(0).to_numpy())
        dwell, spk = both[0], both[1] * 2 if radial else both[1] + both[1][::-1, ::-1]
        gone = dwell <= least
        if smooth > 1:
            r = smooth // 2
            for axis in range(len(shape)):
                pad = [(r, smooth - 1 - r) if k == axis else (0, 0) for k in range(len(shape))]
                dwell, spk = (np.apply_along_axis(lambda v: np.convolve(v, np.ones(smooth) / smooth, "valid"), axis, np.pad(t, pad, mode="edge")) for t in (dwell, spk))
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.where(gone, np.nan, spk / dwell).ravel()
        made = {k: [rows[k].iloc[0]] * rate.size for k in names}
        spots = {c: g.ravel() - (0 if radial else h) for c, g, h in zip(place, np.indices(shape), half)}
        return pd.DataFrame({**made, **spots, "rate": rate})

    counts = dwell.join(spk, [*names, *place], "full").select(*keys, *place, "dwell", "spk")
    types = [f"{k} {counts.schema[k].dataType.simpleString()}" for k in names] + [f"{c} int" for c in place]
    out = counts.groupBy(*keys).applyInPandas(divide, ", ".join([*types, "rate double"]))
    return out.withColumn("rate", F.when(~F.isnan("rate"), F.col("rate")))


def boundaries(m: DataFrame, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``m`` with ``boundary``: whether one of a bin's four neighbours in the map has another label (null is one too)."""
    sides = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    names = [*keys, "gy", "gx"]
    around = m.select(*keys, "gy", "gx", F.struct(F.col(label).alias("v")).alias("__n"), F.inline(sides))
    around = around.select(*keys, (F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx"), "__n")
    met = m.select(*names, label).join(around, names)
    other = met.groupBy(*names).agg(F.max(~F.col(label).eqNullSafe(F.col("__n.v"))).alias("boundary"))
    return m.join(other, names, "left").withColumn("boundary", F.coalesce("boundary", F.lit(False)))


def gravity(m: DataFrame, bin_cm: float, width_cm: float = 16.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, gy, gx, simple, fy, fx`` for each known bin: its pull towards others, as a sum and as a force.

    The sum of ``rate * other / d^2`` over bins up to ``width_cm`` away along each
    axis, and of the same along the line between them, rows and columns apart; a
    bin pulls towards the smaller index where the other lies there.
    """
    w = math.ceil(width_cm / bin_cm)
    apart = [(dy, dx, bin_cm**2 * (dy * dy + dx * dx)) for dy in range(-w, w + 1) for dx in range(-w, w + 1) if dy or dx]
    taps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1 / d2).alias("s"), F.lit(dy * d2**-1.5).alias("ky"), F.lit(dx * d2**-1.5).alias("kx")) for dy, dx, d2 in apart])
    known = m.where("rate is not null").select(*keys, "gy", "gx", "rate")
    spread = known.select(*keys, F.col("rate").alias("b"), "gy", "gx", F.inline(taps))
    spread = spread.select(*keys, (F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx"), "b", "s", "ky", "kx")
    sums = spread.groupBy(*keys, "gy", "gx").agg(*[F.sum(F.col("b") * F.col(c)).alias(c) for c in ("s", "ky", "kx")])
    both = known.join(sums, [*keys, "gy", "gx"], "left")
    return both.select(*keys, "gy", "gx", *[(F.col("rate") * F.coalesce(c, F.lit(0.0))).alias(to) for c, to in (("s", "simple"), ("ky", "fy"), ("kx", "fx"))])


def stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """``n, r`` over bins that are known in both maps."""
    both = first.select("gy", "gx", F.col("rate").alias("a")).join(second.select("gy", "gx", F.col("rate").alias("b")), ["gy", "gx"])
    return _corr(both.where("a is not null and b is not null"), [], "a", "b")


def coherence(m: DataFrame) -> DataFrame:
    """``n, r``: correlation of each bin with the mean of its known neighbours."""
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    known = m.where("rate is not null").select("gy", "gx", "rate")
    near = known.select(F.col("rate").alias("b"), "gy", "gx", F.inline(around)).select((F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx"), "b")
    means = near.groupBy("gy", "gx").agg(F.avg("b").alias("b"))
    return _corr(known.join(means, ["gy", "gx"]), [], "rate", "b")


def regional_maxima(m: DataFrame, least: float = 0.0) -> DataFrame:
    """``gy, gx, rate`` of bins above ``least`` that are the largest of their 3 x 3; unknown bins count as 0."""
    zero = m.select("gy", "gx", F.coalesce("rate", F.lit(0.0)).alias("rate"))
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    top = zero.select("rate", "gy", "gx", F.inline(around)).groupBy((F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx")).agg(F.max("rate").alias("top"))
    return zero.join(top, ["gy", "gx"]).where((F.col("rate") > least) & (F.col("rate") == F.col("top"))).select("gy", "gx", "rate")


def centroids(m: DataFrame, label: str) -> DataFrame:
    """Rate-weighted centre of each label's bins."""
    r = F.col("rate")
    return m.where("rate is not null").groupBy(label).agg(ratio(F.sum(r * F.col("gx")), F.sum(r)).alias("cx"), ratio(F.sum(r * F.col("gy")), F.sum(r)).alias("cy"))


def weight_cut(rows: DataFrame, weight: str, share: float = 0.95, order: str = "id") -> DataFrame:
    """The heaviest rows up to and including the first whose running sum passes ``share`` of the total (peaks of one map)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(weight), order)
    before = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum(weight).over(Window.partitionBy(F.lit(0)))
    return rows.withColumns({"__b": F.coalesce(before, F.lit(0.0)), "__t": total}).where(F.col("__b") <= share * F.col("__t")).drop("__b", "__t")
