"""Bins, histograms and occupancy-normalised rate maps.

Maps are small tables of bins whatever the number of samples: samples are
aggregated first, smoothing and normalising run over bins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions.circular import direction_bin, ratio


def xy_bin(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("int")


def speed_bin(speed: Column, low: float = 5.0, size: float = 4.0, high: float = 45.0) -> Column:
    """0 below ``low``, then bins of ``size``, one more above ``high``."""
    n = math.ceil((high - low) / size)
    return F.least(F.greatest(F.floor((speed - low) / size) + 1, F.lit(0)), F.lit(n + 1)).cast("int")


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """``gy, gx`` of every bin of a map."""
    cells = spark.range(height * width)
    return cells.select(F.floor(F.col("id") / width).cast("int").alias("gy"), (F.col("id") % width).cast("int").alias("gx"))


def counted(samples: DataFrame, size: float, to: str) -> DataFrame:
    """Samples in each bin that has any."""
    seen = samples.where("x is not null and y is not null")
    return seen.groupBy(xy_bin(F.col("y"), size).alias("gy"), xy_bin(F.col("x"), size).alias("gx")).agg(F.count("*").cast("double").alias(to))


def joint_activity(spikes: DataFrame, width: float, most: float | None = None) -> DataFrame:
    """``b, n``: spikes of all cells by time bin, without cells that fire more than ``most`` times a second over the recording."""
    if most is not None:
        length = F.broadcast(spikes.agg(F.max("t_s").alias("__d")))
        slow = spikes.groupBy("tet", "cell").agg(F.count("*").alias("n")).crossJoin(length).where(F.col("n") / F.col("__d") <= most)
        spikes = spikes.join(slow.select("tet", "cell"), ["tet", "cell"], "left_semi")
    return spikes.groupBy(F.floor(F.col("t_s") / width).alias("b")).agg(F.count("*").alias("n"))


def stencil(cells: DataFrame, columns: list[str], offsets: list[tuple[int, int, float]], keys: tuple[str, ...] = ()) -> DataFrame:
    """Weighted sums over neighbouring bins; outside the map counts as 0. Bins that are not there get no row."""
    taps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in offsets])
    spread = cells.select(*keys, "gy", "gx", *columns, F.inline(taps))
    sums = spread.groupBy(*keys, (F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx")).agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in columns])
    return sums.join(cells.select(*keys, "gy", "gx"), [*keys, "gy", "gx"])


def boxcar(k: int) -> list[tuple[int, int, float]]:
    h = k // 2
    return [(dy, dx, 1.0 / (k * k)) for dy in range(-h, h + 1) for dx in range(-h, h + 1)]


def gaussian(sigma: float) -> list[tuple[int, int, float]]:
    """Separable, cut at 4 sigma, normalised to 1."""
    r = int(4 * sigma + 0.5)
    g = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    total = sum(g)
    return [(dy, dx, g[dy + r] * g[dx + r] / total**2) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def gaussian_taps(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    g = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    total = sum(g)
    return [x / total for x in g]


def rate_map(
    pos: DataFrame,
    spike_pos: DataFrame,
    size: float,
    shape: tuple[int, int],
    fs: float,
    offsets: list[tuple[int, int, float]] | None,
    norm: str | float | None = None,
    keys: tuple[str, ...] = (),
    weight: Column | None = None,
    mask: Column | None = None,
) -> DataFrame:
    """``keys, gy, gx, dwell, spk, rate`` of a dense map for each cell ``keys``; ``rate`` is null where no sample fell.

    ``norm``: None gives spikes a second; ``pos`` spikes a sample; ``counts``
    leaves dwell as a count and unsmoothed; ``max`` and ``mean`` divide by the
    largest rate and by the mean rate of the trial; ``rank`` is the percentage
    rank; a number is the percentile to divide by. ``weight`` is what a spike
    counts; only samples where ``mask`` holds count as dwell, all spikes do.
    """
    names = list(keys)
    if mask is not None:
        pos = pos.where(mask)
    seen_spikes = spike_pos.where("x is not null and y is not null")
    by = [xy_bin(F.col("y"), size).alias("gy"), xy_bin(F.col("x"), size).alias("gx")]
    spk = seen_spikes.groupBy(*keys, *by).agg(F.sum(weight.cast("double") if weight is not None else F.lit(1.0)).alias("spk"))
    dense = grid(pos.sparkSession, *shape).join(F.broadcast(counted(pos, size, "dwell")), ["gy", "gx"], "left")  # as many rows as bins
    cells = spike_pos.select(*keys).distinct().crossJoin(F.broadcast(dense)) if keys else dense
    cells = cells.join(spk, [*names, "gy", "gx"], "left")
    cells = cells.select(*keys, "gy", "gx", F.coalesce("dwell", F.lit(0.0)).alias("dwell"), F.coalesce("spk", F.lit(0.0)).alias("spk"))
    seen = cells.select(*keys, "gy", "gx", (F.col("dwell") > 0).alias("seen"))
    if offsets and norm != "counts":
        cells = stencil(cells, ["dwell", "spk"], offsets, keys)
    if norm is None or norm == "mean":
        cells = cells.withColumn("dwell", F.col("dwell") / fs)
    rate = F.when(F.col("seen"), ratio(F.col("spk"), F.col("dwell")))
    out = cells.join(seen, [*names, "gy", "gx"]).withColumn("rate", rate).drop("seen")
    if norm in (None, "counts", "pos"):
        return out
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # the bins of one map
    if norm == "rank":
        w = whole.orderBy(F.col("rate").isNull(), F.round("rate", 9), "gy", "gx")  # equal but for rounding is equal
        return out.withColumn("rate", F.when(F.col("rate").isNotNull(), (F.row_number().over(w) - 1) * 100.0 / F.count("rate").over(whole)))
    if norm == "mean":
        length = F.broadcast(pos.agg((F.count("*") / F.lit(fs)).alias("__d")))
        fired = spike_pos.groupBy(*keys).agg(F.count("*").alias("__n"))
        out = (out.join(fired, names) if keys else out.crossJoin(F.broadcast(fired))).crossJoin(length)
        return out.withColumn("rate", ratio(F.col("rate") * F.col("__d"), F.col("__n"))).drop("__d", "__n")
    by_what = F.max("rate") if norm == "max" else F.percentile("rate", F.lit(float(norm) / 100))
    return out.withColumn("rate", ratio(F.col("rate"), by_what.over(whole)))


def fill_unvisited(m: DataFrame, how: float | str, value: str = "rate", keys: tuple[str, ...] = ()) -> DataFrame:
    """A map with its null bins filled: with a number, or, if ``how`` is ``nearest``, from the nearest known bin.

    Distances are between bin centres, ties go to the smaller row, then column. A
    map without a known bin stays as it is. One map is one group, of bounded size.
    """
    if how != "nearest":
        return m.withColumn(value, F.coalesce(F.col(value), F.lit(float(how))))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["gy", "gx"])
        v, at = rows[value].to_numpy(float), rows[["gy", "gx"]].to_numpy(np.int64)
        known, gaps = np.flatnonzero(~np.isnan(v)), np.flatnonzero(np.isnan(v))
        if len(known):
            for part in np.array_split(gaps, len(gaps) // 512 + 1):
                apart = ((at[part, None, :] - at[None, known, :]) ** 2).sum(axis=2)
                v[part] = v[known[apart.argmin(axis=1)]]
        return rows.assign(**{value: v})

    part = m.withColumn(value, F.col(value).cast("double"))
    return part.groupBy(*keys).applyInPandas(fill, part.schema)


def rate_at(points: DataFrame, m: DataFrame, size: float, to: str = "rate", keys: tuple[str, ...] = ()) -> DataFrame:
    """``points`` with the map's value at their bin; null outside the map and where it is unknown."""
    binned = points.withColumns({"gy": xy_bin(F.col("y"), size), "gx": xy_bin(F.col("x"), size)})
    values = m.select(*keys, "gy", "gx", F.col("rate").alias(to))
    return binned.join(values, [*keys, "gy", "gx"], "left").drop("gy", "gx")


#: Widths of the rings that an adaptive map's first pass looks at, in units of the largest radius.
_RINGS = 64


def adaptive_map(pos: DataFrame, spike_pos: DataFrame, size: float, shape: tuple[int, int], fs: float, alpha: float = 2500.0, reach: float = 15.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, gy, gx, rate, radius`` of a map whose circles grow until they hold enough.

    Around a bin's centre a circle grows through the distances at which samples
    lie, those of 0 left out, until ``spikes > alpha fs^2 / (d dwell)^2``; then
    the rate is its spikes a second. Bins that no circle up to ``reach`` satisfies
    are null. What must be exceeded only falls as a circle grows, so a first pass
    over ring totals finds the ring in which it is passed, and only that ring's
    samples are put in order.
    """
    names = list(keys)
    cells = [(F.col("gx") + 0.5) * size - F.col("x"), (F.col("gy") + 0.5) * size - F.col("y")]
    span = math.ceil(reach / size)
    step = reach / _RINGS

    def around(rows: DataFrame) -> DataFrame:
        near = rows.where("x is not null and y is not null").select(
            "*", F.explode(F.sequence(xy_bin(F.col("y"), size) - span, xy_bin(F.col("y"), size) + span)).alias("gy")
        )
        near = near.select("*", F.explode(F.sequence(xy_bin(F.col("x"), size) - span, xy_bin(F.col("x"), size) + span)).alias("gx"))
        near = near.where(F.col("gy").between(0, shape[0] - 1) & F.col("gx").between(0, shape[1] - 1))
        d2 = cells[0] * cells[0] + cells[1] * cells[1]
        return near.withColumn("d2", d2).where(F.col("d2") <= reach * reach).withColumn("ring", F.floor(F.sqrt("d2") / step))

    here = ["gy", "gx", "ring", "d2"]
    stay = around(pos.select("x", "y")).groupBy(*here).agg(F.count("*").cast("double").alias("dwell"))
    hit = around(spike_pos.select(*keys, "x", "y")).groupBy(*keys, *here).agg(F.count("*").cast("double").alias("spk"))
    enough = lambda spk, dwell, d2: spk * dwell * dwell * d2 > F.lit(alpha * fs * fs)

    # rings: the first whose outermost sample satisfies the inequality
    ring_stay = stay.groupBy("gy", "gx", "ring").agg(F.sum("dwell").alias("dwell"), F.max("d2").alias("d2"))
    ring_hit = hit.groupBy(*keys, "gy", "gx", "ring").agg(F.sum("spk").alias("spk"))
    bins = spike_pos.select(*keys).distinct().crossJoin(F.broadcast(grid(pos.sparkSession, *shape))) if keys else grid(pos.sparkSession, *shape)
    rings = bins.join(ring_stay, ["gy", "gx"]).join(ring_hit, [*names, "gy", "gx", "ring"], "left").withColumn("spk", F.coalesce("spk", F.lit(0.0)))
    at = Window.partitionBy(*keys, "gy", "gx").orderBy("ring")  # _RINGS rows at most
    rings = rings.withColumns({"all_spk": F.sum("spk").over(at), "all_dwell": F.sum("dwell").over(at)})
    passed = rings.where(enough(F.col("all_spk"), F.col("all_dwell"), F.col("d2")))
    first = passed.groupBy(*keys, "gy", "gx").agg(
        F.min(F.struct("ring", (F.col("all_spk") - F.col("spk")).alias("spk0"), (F.col("all_dwell") - F.col("dwell")).alias("dwell0"))).alias("f")
    )
    first = first.select(*keys, "gy", "gx", "f.*")
    # within that ring: the first distance
    inside = first.join(stay, ["gy", "gx", "ring"]).join(hit, [*names, "gy", "gx", "ring", "d2"], "left").withColumn("spk", F.coalesce("spk", F.lit(0.0)))
    near = Window.partitionBy(*keys, "gy", "gx").orderBy("d2")
    sums = inside.withColumns({"s": F.col("spk0") + F.sum("spk").over(near), "w": F.col("dwell0") + F.sum("dwell").over(near)})
    best = sums.where((F.col("d2") > 0) & enough(F.col("s"), F.col("w"), F.col("d2"))).groupBy(*keys, "gy", "gx").agg(F.min(F.struct("d2", "s", "w")).alias("b"))
    return bins.join(best, [*names, "gy", "gx"], "left").select(*keys, "gy", "gx", (ratio(F.col("b.s"), F.col("b.w")) * fs).alias("rate"), F.sqrt("b.d2").alias("radius"))


def rate_map_1d(pos: DataFrame, spike_pos: DataFrame, size: float, fs: float, k: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, gx, dwell, spk, rate`` along one axis, for all cells at once; boxcar of ``k`` bins, 0 outside."""
    h = k // 2
    dwell = pos.where("x is not null").groupBy(xy_bin(F.col("x"), size).alias("gx")).agg(F.count("*").cast("double").alias("dwell"))
    spk = spike_pos.where("x is not null").groupBy(*keys, xy_bin(F.col("x"), size).alias("gx")).agg(F.count("*").cast("double").alias("spk"))
    spread = F.explode(F.sequence(F.col("gx") - h, F.col("gx") + h))
    wide = dwell.select("dwell", "gx", spread.alias("to")).groupBy("to").agg((F.sum("dwell") / k).alias("dwell"))
    dense = dwell.select(F.col("gx").alias("to")).join(wide, "to")
    spks = spk.select(*keys, "spk", "gx", spread.alias("to")).groupBy(*keys, "to").agg((F.sum("spk") / k).alias("spk"))
    all_cells = spk.select(*keys).distinct().crossJoin(F.broadcast(dense)) if keys else dense
    out = all_cells.join(spks, [*keys, "to"], "left").withColumn("spk", F.coalesce("spk", F.lit(0.0)))
    return out.select(*keys, F.col("to").alias("gx"), (F.col("dwell") / fs).alias("dwell"), "spk", ratio(F.col("spk"), F.col("dwell") / fs).alias("rate"))


def direction_map(kin: DataFrame, spike_kin: DataFrame, fs: float, bin_deg: float = 5.0, k: int = 5, min_speed: float = 5.0) -> DataFrame:
    """``b, dwell, spk, rate`` around the circle, for samples faster than ``min_speed``; circular boxcar."""
    n, h = int(360 / bin_deg), k // 2
    hist = lambda df, to: df.where(F.col("speed") > min_speed).groupBy(direction_bin(F.col("dir"), bin_deg).alias("b")).agg(F.count("*").cast("double").alias(to))
    both = kin.sparkSession.range(n).select(F.col("id").cast("int").alias("b")).join(F.broadcast(hist(kin, "dwell")), "b", "left").join(F.broadcast(hist(spike_kin, "spk")), "b", "left")
    spread = both.select("dwell", "spk", F.explode(F.transform(F.sequence(F.col("b") - h, F.col("b") + h), lambda x: F.pmod(x, F.lit(n)))).alias("b"))
    out = spread.groupBy("b").agg((F.coalesce(F.sum("dwell"), F.lit(0.0)) / k / fs).alias("dwell"), (F.coalesce(F.sum("spk"), F.lit(0.0)) / k).alias("spk"))
    return out.withColumn("rate", ratio(F.col("spk"), F.col("dwell")))


def resultant(dir_map: DataFrame, bin_deg: float = 5.0) -> DataFrame:
    """``r``: mean resultant length of a directional map, corrected for the width of its bins."""
    theta = F.col("b") * math.radians(bin_deg) - math.pi
    half = math.radians(bin_deg) / 2
    c, s, t = (F.sum(e) for e in (F.col("rate") * F.cos(theta), F.col("rate") * F.sin(theta), F.col("rate")))
    return dir_map.agg((ratio(F.sqrt(c * c + s * s), t) * (half / math.sin(half))).alias("r"))
