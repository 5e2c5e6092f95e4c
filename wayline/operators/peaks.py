"""Peaks of a rate along a recording: how far they reach, and which stand for themselves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.indexing import widths
from wayline.operators.joins import interval_join
from wayline.operators.sequence import label_changes, running_sum
from wayline.operators.signal import in_chunks
from wayline.storage import materialize


def find_peaks(rates: DataFrame, value: str, fs: float, least: float = 2.0, share: float = 0.5, most_s: float = 10.0, order: str = "i") -> DataFrame:
    """``i, rate, left, right, distinct`` of samples above both neighbours and at least ``least``.

    A peak reaches on either side to the sample that is first below ``share`` of
    it, at most ``most_s`` seconds; ``left`` belongs to it, ``right`` doesn't. It is
    distinct if what it covers meets nothing that a higher peak covers (of equal
    ones the later is higher). A series of rates has no nulls.
    """
    reach = int(fs * most_s)

    def kernel(x: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
        low = np.where(x >= least, x, 0)  # beyond an end its sample repeats, so that is no peak
        out = {c: np.full(len(x), np.nan) for c in ("a", "b")}
        first, last = np.flatnonzero(inside)[[0, -1]]
        for p in np.flatnonzero((low[1:-1] > low[:-2]) & (low[1:-1] > low[2:])) + 1:
            start, end = max(first, p - reach), min(last + 1, p + reach)
            below = np.flatnonzero(x[start:p] < share * x[p])
            after = np.flatnonzero(x[p:end] < share * x[p])
            out["a"][p] = p - start - (below[-1] if len(below) else 0)
            out["b"][p] = after[0] if len(after) else reach
        return out

    found = in_chunks(rates, F.col(value), kernel, {"a": "double", "b": "double"}, reach + 1, (), order, edge="nearest")
    found = found.where(F.nanvl("a", F.lit(None)).isNotNull()).join(rates.select(order, F.col(value).alias("rate")), order)
    at = F.col(order)
    peaks = found.select(at.alias("i"), "rate", (at - F.col("a")).cast("long").alias("left"), (at + F.col("b")).cast("long").alias("right"))
    peaks = materialize(peaks, "peaks")  # compared with itself
    # what may meet lies in the same or the next stretch of twice the reach
    spread = peaks.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor(F.col("left") / (2 * reach)), F.floor(F.col("right") / (2 * reach))))))
    p, q = spread.alias("p"), spread.alias("q")
    higher = F.struct("q.rate", "q.i") > F.struct("p.rate", "p.i")
    meets = (F.col("p.__b") == F.col("q.__b")) & (F.col("q.left") < F.col("p.right")) & (F.col("p.left") < F.col("q.right"))
    covered = p.join(q, meets & higher, "left_semi").select("i").distinct()
    return peaks.join(covered.withColumn("__c", F.lit(True)), "i", "left").withColumn("distinct", F.col("__c").isNull()).drop("__c")


def peak_widths(peaks: DataFrame, pos: DataFrame) -> DataFrame:
    """``i, rate, width`` of distinct peaks: the largest distance between positions that they cover, ends included."""
    kept = peaks.where("distinct")
    covered = interval_join(pos.select(F.col("i").alias("at"), "x", "y"), kept.select(F.col("i").alias("peak"), "left", "right"), "at", "left", "right", 4096.0)
    return kept.join(widths(covered, "peak").withColumnRenamed("peak", "i"), "i", "left").select("i", "rate", "width")


def find_run_peaks(
    samples: DataFrame, value: str = "rate", label: str = "label", least: float = 2.0, share: float = 0.5, wing: float = 0.2, order: str = "i"
) -> DataFrame:
    """``run, label, first, last, i, rate, start, end`` of the runs whose peak stays mostly inside.

    A run is a stretch of samples of one label other than 0; those whose highest
    rate is above ``least`` count, ``i`` being the first sample that has it. The peak
    reaches to either side while the rate is at least ``share`` of the highest, both
    ends included. Where it reaches a border of the run it goes on beyond it as a
    wing, which must end (a sample below the share) within the run's length and take
    less than ``wing`` of it. Runs are numbered from 1 in order. ``order`` is dense.

    Each run asks for the nearest samples below its share: inside to the left and
    right of the peak, and outside of both borders within its own length. So it takes
    one interval join and grouped minima and maxima; a run may be as long as the series.
    """
    at = F.col(order)
    labelled = label_changes(samples.select(order, F.col(label).alias("label"), F.col(value).alias("rate")), "label", "run", order=order)
    inside = labelled.where("run > 0").groupBy("run")
    runs = inside.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("label").alias("label"), F.max(F.struct("rate", (-at).alias("o"))).alias("top"))
    runs = runs.where(F.col("top.rate") > least).select("run", "label", "first", "last", (-F.col("top.o")).alias("i"), "top.rate")
    runs = materialize(runs.withColumn("__n", F.col("last") - F.col("first") + 1), "runs")
    spans = runs.select("run", "first", "last", "__n", F.col("i").alias("peak"), (F.col("rate") * share).alias("low"), (F.col("first") - F.col("__n")).alias("from"), (F.col("last") + F.col("__n") - 1).alias("to"))
    below = interval_join(labelled.select(at.alias("at"), F.col("rate").alias("r")), spans, "at", "from", "to", 4096.0).where("r < low")
    ends = below.groupBy("run").agg(
        F.max(F.when((F.col("at") >= F.col("first")) & (F.col("at") < F.col("peak")), F.col("at"))).alias("a"),
        F.min(F.when((F.col("at") > F.col("peak")) & (F.col("at") <= F.col("last")), F.col("at"))).alias("b"),
        F.max(F.when(F.col("at") < F.col("first"), F.col("at"))).alias("left"),
        F.min(F.when(F.col("at") >= F.col("last"), F.col("at"))).alias("right"),
    )
    met = runs.join(ends, "run", "left")
    before, after = F.col("first") - 1 - F.col("left"), F.col("right") - F.col("last")
    fits = lambda inner, width: inner.isNotNull() | F.coalesce(width < F.col("__n") * wing, F.lit(False))
    good = met.where(fits(F.col("a"), before) & fits(F.col("b"), after)).select(
        "run", "label", "first", "last", "i", "rate",
        F.coalesce(F.col("a") + 1, F.col("first") - before).alias("start"),
        F.coalesce(F.col("b") - 1, F.col("last") + after).alias("end"),
    )
    return running_sum(good.drop("run"), F.lit(1), "run", order="first").withColumn("run", F.col("run").cast("long"))


def run_peak_widths(peaks: DataFrame, pos: DataFrame) -> DataFrame:
    """``peaks`` with ``width``: the largest distance between positions from ``start`` to ``end``; null where there are none."""
    covered = interval_join(pos.select(F.col("i").alias("at"), "x", "y"), peaks.select("run", "start", "end"), "at", "start", "end", 4096.0)
    return peaks.join(widths(covered, "run"), "run", "left")


def mean_and_sem(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, n, mean, sem`` of a column; nulls don't count."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))
