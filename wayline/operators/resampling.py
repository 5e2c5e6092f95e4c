"""Correlation under permutation and resampling.

Replicates run side by side, some to a task; random orders and draws come from a
hash of the replicate and the row number, which any rerun of a lost task repeats.
A task reads the rows as they lie in the shared folder, once for its replicates,
so nothing is shuffled that grows with rows times replicates.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.circular import correlation, ratio
from wayline.functions.md5 import first_bits, spans
from wayline.operators.sequence import running_sum
from wayline.storage import materialize, read_batches

HASH_BITS = 60


def draw(seed: int, *parts: Column) -> Column:
    """A whole number below 2^60 from a hash of the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(correlation(F.col("x"), F.col("y")).alias("r"))


#: Rows whose numbers of draws one task holds, a byte each.
_SLOTS = 1 << 26
#: Rows that one task puts into a random order at once, 16 bytes each.
_SORTED = 1 << 22
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_TOTALS = "rep int, " + ", ".join(f"{c} double" for c in _SUMS)


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row what it adds to the sums; a row without ``x`` or ``y`` adds nothing."""
    known = ~(np.isnan(x) | np.isnan(y))
    x, y = np.where(known, x, 0.0), np.where(known, y, 0.0)
    return np.stack([known.astype(float), x, y, x * x, y * y, x * y], axis=1)


def _correlation_of_sums() -> Column:
    n, sx, sy, sxx, syy, sxy = map(F.col, _SUMS)
    return ratio(n * sxy - sx * sy, F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * syy - sy * sy, F.lit(0.0))))


def _kept(rows: DataFrame, n: int, order: str) -> DataFrame:
    """``rows`` as files of the shared folder, cut and sorted by ``order``."""
    return materialize(rows.repartitionByRange(n // (1 << 19) + 1, order).sortWithinPartitions(order), "rows")


def _side_by_side(rows: DataFrame, n: int, run: Callable[[int], pd.DataFrame], schema: str) -> DataFrame:
    """What ``run`` gives for 0 to ``n``, each in a task of its own; written at once, as it takes long and is read more than once."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for task in part["id"].tolist():
                yield run(task)

    return materialize(rows.sparkSession.range(0, n, 1, n).mapInPandas(each, schema), "replicates")


def _resampled(rows: DataFrame, n_slots: int, k: int, draws: Callable[[int], Iterator[np.ndarray]]) -> DataFrame:
    """``rep`` and sums over the rows ``slot, x, y`` that ``draws`` takes for each of ``k`` replicates.

    ``rows`` were kept in files; ``draws(rep)`` gives slots from 0 to ``n_slots``, as
    many as there are. A task counts how often some replicates draw each slot and
    then reads the rows once. Beyond ``_SLOTS`` rows a task looks at some of the
    slots only, and draws are made again for each such range.
    """
    path, spark = rows._wayline_path, rows.sparkSession
    n_ranges = -(-n_slots // _SLOTS)
    width = -(-n_slots // n_ranges)
    at_once = max(1, min(_SLOTS // width, k // (8 * spark.sparkContext.defaultParallelism)))
    n_groups = -(-k // at_once)

    def run(task: int) -> pd.DataFrame:
        reps, low = range(task // n_ranges * at_once + 1, min(task // n_ranges * at_once + at_once, k) + 1), task % n_ranges * width
        times = np.zeros((len(reps), width), np.uint8)  # a slot is drawn once on average, at most
        for at, rep in enumerate(reps):
            for slots in draws(rep):
                inside = slots if n_ranges == 1 else slots[(slots >= low) & (slots < low + width)]
                np.add.at(times[at], inside - low, np.uint8(1))
        sums = np.zeros((len(reps), len(_SUMS)))
        for slot, x, y in read_batches(path, ("slot", "x", "y")):
            inside = (slot >= low) & (slot < low + width)
            sums += times[:, slot[inside] - low].astype(float) @ _moments(x[inside], y[inside])
        return pd.DataFrame(sums, columns=_SUMS).assign(rep=list(reps))[["rep", *_SUMS]]

    parts = _side_by_side(rows, n_groups * n_ranges, run, _TOTALS)
    return parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _centred(rows: DataFrame) -> DataFrame:
    """``i, x, y`` less their means, so that little cancels."""
    mean = rows.agg(F.avg("x"), F.avg("y")).first()
    return rows.where("i is not null").select(F.col("i").cast("long").alias("i"), *[(F.col(c).cast("double") - F.lit(m or 0.0)).alias(c) for c, m in zip("xy", mean)])


def permuted(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``rep, r``: correlation of ``x`` with ``y`` in a random order, for ``k`` orders; ``i`` is dense from 0.

    A task makes one order. Beyond ``_SORTED`` rows it deals them by hash to files of
    its own folder first, and sorts one after the other.
    """
    n = max(rows.count(), 1)
    path = _kept(_centred(rows), n, "i")._wayline_path
    bits = max(0, math.ceil(math.log2(n / _SORTED)))

    def ordered(rep: int) -> Iterator[np.ndarray]:
        """``y`` by the hashes of its rows, in parts."""
        with tempfile.TemporaryDirectory() as folder:
            names = [os.path.join(folder, str(b)) for b in range(1 << bits)]
            files = [open(name, "wb") for name in names]
            try:
                for i, y in read_batches(path, ("i", "y")):
                    h = first_bits(f"{seed}:{rep}:", i)
                    part = (h >> np.uint64(HASH_BITS - bits)).astype(np.uint16)
                    order = np.argsort(part, kind="stable")
                    pairs = np.stack([h, y.view(np.uint64)], axis=1)[order]
                    ends = np.cumsum(np.bincount(part, minlength=len(files)))
                    for file, a, b in zip(files, [0, *ends], ends):
                        file.write(pairs[a:b].tobytes())
            finally:
                for file in files:
                    file.close()
            for name in names:
                pairs = np.fromfile(name, np.uint64).reshape(-1, 2)
                os.remove(name)
                y = pairs[:, 1].view(float)[np.argsort(pairs[:, 0], kind="stable")]
                del pairs
                yield y

    def run(task: int) -> pd.DataFrame:
        rep, first, sums = task + 1, 0, np.zeros(len(_SUMS))
        for y in ordered(rep):
            for i, x in read_batches(path, ("i", "x"), "i", first, first + len(y)):
                sums += _moments(x, y[i - first]).sum(axis=0)
            first += len(y)
        return pd.DataFrame([sums], columns=_SUMS).assign(rep=rep)[["rep", *_SUMS]]

    return _side_by_side(rows, k, run, _TOTALS).select("rep", _correlation_of_sums().alias("r"))


def permutation_test(rows: DataFrame, k: int = 100, tails: int = 2, seed: int = 0) -> DataFrame:
    """``r, p``: the share of orders that correlate more strongly, in the same direction if ``tails`` is 1."""
    whole = _sums(rows).select(F.col("r").alias("__r"))
    r, own = F.col("r"), F.col("__r")
    beyond = (F.abs(r) > F.abs(own)) if tails == 2 else F.when(own > 0, r > own).otherwise(r < own)
    at = permuted(rows, k, seed).crossJoin(F.broadcast(whole))
    return at.agg(F.first("__r").alias("r"), F.avg(beyond.cast("double")).alias("p"))


def sign_bootstrap(rows: DataFrame, k: int = 1000, seed: int = 0) -> DataFrame:
    """``r, p``: the share of samples drawn with replacement whose correlation has another sign."""
    n = max(rows.count(), 1)
    kept = _kept(_centred(rows).withColumn("slot", F.col("i")), n, "i")
    path = kept._wayline_path

    def draws(rep: int) -> Iterator[np.ndarray]:
        for (i,) in read_batches(path, ("i",)):
            yield (first_bits(f"{seed}:{rep}:", i) % np.uint64(n)).astype(np.int64)

    own = _sums(kept).select(F.col("r").alias("__r"))
    sign = F.signum(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"))
    at = _resampled(kept, n, k, draws).select(sign.alias("s")).crossJoin(F.broadcast(own))
    return at.agg(F.first("__r").alias("r"), F.avg((F.col("s") != F.signum("__r")).cast("double")).alias("p"))


def mcnemar(counts: DataFrame) -> DataFrame:
    """``counts`` with ``chi2`` and ``p`` for its columns ``b`` and ``c``, the pairs that changed one way and the other.

    Below 25 of them the binomial law gives ``p`` and ``chi2`` is null.
    """

    @F.pandas_udf("double")
    def binomial(b: pd.Series, c: pd.Series) -> pd.Series:
        def p(x: int, n: int) -> float:
            f = sum(math.comb(n, k) for k in range(x + 1)) / 2**n
            return 2 * f if f < 0.5 else 2 * (1 - f)

        return pd.Series([p(x, x + y) if x + y < 25 else math.erfc(abs(x - y) / math.sqrt(2 * (x + y))) for x, y in zip(b, c)])

    b, c = F.col("b"), F.col("c")
    chi2 = F.when(b + c >= 25, F.pow(b - c, 2) / (b + c))
    return counts.withColumns({"chi2": chi2, "p": binomial("b", "c")})


def matched(a: DataFrame, b: DataFrame, size: float, keys: str = "label", value: str = "value", seed: int = 0) -> DataFrame:
    """``side, label, to``: groups of two samples taken so that each bin of group means has as many of either.

    Rows with label 0 belong to no group. Which groups of the fuller side stay is
    drawn by a hash; ``to`` numbers those that stay from 1, by label, on each side.
    """
    both = a.select(F.lit("a").alias("side"), keys, value).unionByName(b.select(F.lit("b").alias("side"), keys, value)).where(F.col(keys) != 0)
    means = both.groupBy("side", keys).agg(F.floor(F.avg(value) / size).alias("bin"))
    n = means.groupBy("bin").agg(F.least(F.count_if(F.col("side") == "a"), F.count_if(F.col("side") == "b")).alias("n"))
    order = Window.partitionBy("side", "bin").orderBy(draw(seed, F.col("side"), F.col(keys)), keys)
    kept = means.join(n, "bin").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n"))
    return running_sum(kept, F.lit(1), "to", ("side",), keys).select("side", keys, F.col("to").cast("long").alias("to"))


def binned_bootstrap(rows: DataFrame, k: int = 100, percent: float = 5.0, low: float = 0.0, high: float | None = None, seed: int = 0) -> DataFrame:
    """``n_bins, r, low, high``: correlation when every bin of ``x`` counts alike, over ``k`` samples.

    ``x`` from ``low`` to ``high`` (its largest value) is cut into bins of
    ``percent`` of that range; from each bin that has any, as many rows as the
    poorest has are drawn with replacement, ``k`` times. ``r`` is the mean, ``low``
    and ``high`` the 2.5 and 97.5 percentiles of the samples' correlations.
    """
    top = high if high is not None else rows.agg(F.max("x")).first()[0]
    if top is None or top <= low:
        return rows.sparkSession.createDataFrame([(0, None, None, None)], "n_bins int, r double, low double, high double")
    width = (top - low) * percent / 100
    inside = rows.where(F.col("x").between(low, top)).select("i", "x", "y", F.least(F.floor((F.col("x") - low) / width), F.lit(math.ceil(100 / percent) - 1)).alias("bin"))
    sizes = inside.groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect()  # 100 / percent rows
    if not sizes:
        return rows.sparkSession.createDataFrame([(0, None, None, None)], "n_bins int, r double, low double, high double")
    poorest, starts = min(r.n for r in sizes), np.cumsum([0, *[r.n for r in sizes]]).tolist()
    # bins one after the other, in each the rows' own order
    starting = rows.sparkSession.createDataFrame([(r.bin, a) for r, a in zip(sizes, starts)], "bin long, __a long")
    placed = running_sum(inside, F.lit(1), "at", ("bin",), "i").join(F.broadcast(starting), "bin")
    means = inside.agg(F.avg("x"), F.avg("y")).first()
    x, y = (F.col(c).cast("double") - F.lit(m or 0.0) for c, m in zip("xy", means))
    kept = materialize(placed.select((F.col("at") - 1 + F.col("__a")).cast("long").alias("slot"), x.alias("x"), y.alias("y")), "rows")

    def draws(rep: int) -> Iterator[np.ndarray]:
        for (b, n), a in zip(sizes, starts):
            for d in spans(1, poorest + 1):
                yield (first_bits(f"{seed}:{rep}:{b}:", d) % np.uint64(n)).astype(np.int64) + a

    r = _resampled(kept, starts[-1], k, draws).select(_correlation_of_sums().alias("r"))
    spread = F.percentile("r", F.array(F.lit(0.025), F.lit(0.975)))  # of k values
    return r.agg(F.avg("r").alias("r"), spread.alias("s")).select(F.lit(len(sizes)).cast("int").alias("n_bins"), "r", F.col("s")[0].alias("low"), F.col("s")[1].alias("high"))
