"""Numbering, repeating and measuring rows of a series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.sequence import framed, running_sum


def is_power_of_2(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def next_power_of_2(x: Column) -> Column:
    """The least power of 2 that is not below ``x``; 1 below 1."""
    bits = F.length(F.conv(F.greatest(x, F.lit(1)).cast("long") - 1, 10, 2))
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2), bits).cast("long"))


def duplicate_index(df: DataFrame, value: str, to: str = "sub", order: str = "i") -> DataFrame:
    """Numbers the rows of each value from 0, in order; one value may have very many."""
    return running_sum(df, F.lit(1), to, (value,), order).withColumn(to, (F.col(to) - 1).cast("long"))


def repeated(df: DataFrame, times: str, to: str = "k") -> DataFrame:
    """Each row ``times`` times, numbered from 0; null and 0 give none."""
    return df.where(F.col(times) > 0).withColumn(to, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1)))


def reindexed(df: DataFrame, mask: Column, to: str = "at", order: str = "i") -> DataFrame:
    """The rows where ``mask`` holds, with their number among those, from 0."""
    marked = df.withColumn("__m", F.coalesce(mask, F.lit(False)))
    return running_sum(marked, F.col("__m").cast("int"), to, order=order).where("__m").withColumn(to, (F.col(to) - 1).cast("long")).drop("__m")


def segments(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``i, x1, y1, x2, y2``: the line from each sample to the next."""
    near = framed(df, {"x2": lambda w: F.lead(x).over(w), "y2": lambda w: F.lead(y).over(w), "__n": lambda w: F.lead("i").over(w)}, 0, 1)
    return near.where("__n is not null").select("i", F.col(x).alias("x1"), F.col(y).alias("y1"), "x2", "y2")


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points, by a sweep along x."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    out = []
    for side in (p, p[::-1]):
        kept: list[np.ndarray] = []
        for q in side:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (q[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (q[0] - kept[-2][0]):
                kept.pop()
            kept.append(q)
        out += kept[:-1]
    return np.array(out)


def widths(df: DataFrame, label: str, x: str = "x", y: str = "y") -> DataFrame:
    """``label, width``: the largest distance between two positions of each label.

    Such positions are corners of the label's convex hull: batches send on only
    the corners of theirs. Null positions don't count.
    """
    part = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(label).alias("label"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kind = part.schema["label"].dataType.simpleString()

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, rows in b.groupby("label", dropna=False):
                h = _hull(rows[["x", "y"]].to_numpy())
                yield pd.DataFrame({"label": [name] * len(h), "x": h[:, 0], "y": h[:, 1]})

    @F.pandas_udf("double")
    def widest(points: pd.Series) -> pd.Series:
        def one(flat: np.ndarray) -> float:
            h = _hull(np.asarray(flat).reshape(-1, 2))
            return max(float(np.sqrt(((h[k:] - h[k]) ** 2).sum(axis=1)).max()) for k in range(len(h)))

        return points.map(one)

    kept = part.mapInPandas(corners, f"label {kind}, x double, y double")
    found = kept.groupBy("label").agg(F.flatten(F.collect_list(F.array("x", "y"))).alias("points"))  # a few corners a batch
    return found.select(F.col("label").alias(label), widest("points").alias("width"))


def kth_largest(df: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k``-th largest value, from 1, in one row; null if there are fewer. ``k`` is small."""
    top = df.where(F.col(value).isNotNull()).select(value).orderBy(F.desc(value)).limit(k)
    return top.agg(F.when(F.count("*") == k, F.min(value)).alias(value))


def most_frequent(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, value, n``: the most frequent value, ties to the smallest; nulls don't count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), value)).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias(value), (-F.col("b.n")).alias("n"))
