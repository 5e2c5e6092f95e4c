"""Gathers, interval, range, as-of and nearest joins.

Range conditions are turned into equi-joins on time buckets with the exact
condition as a residual, so no side has to fit into memory and no pair of
distant rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.circular import ratio
from wayline.operators.sequence import last_known


#: Half microseconds of time in a chunk of an as-of join: some two minutes of samples.
_SPAN = 1 << 28


def gather(spikes: DataFrame, pos: DataFrame) -> DataFrame:
    """Spikes with the columns of their position sample."""
    return spikes.join(pos.withColumnRenamed("i", "pos_i"), "pos_i")


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Points with each span that holds them, both ends included."""
    p = points.withColumn("__b", F.floor(F.col(at) / bucket))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return p.join(s, "__b").where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__b")


def outside_spans(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Points that no span holds, both ends included."""
    p = points.withColumn("__b", F.floor(F.col(at) / bucket)).alias("p")
    s = spans.select(start, end, F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("__b")).alias("s")
    held = (F.col("p.__b") == F.col("s.__b")) & (F.col(f"p.{at}") >= F.col(f"s.{start}")) & (F.col(f"p.{at}") <= F.col(f"s.{end}"))
    return p.join(s, held, "left_anti").drop("__b")


def lag_pairs(spikes: DataFrame, window: float, keys: tuple[str, ...] = ("tet", "cell"), inclusive: bool = False) -> DataFrame:
    """``keys, lag`` of ordered pairs of one cell less than ``window`` apart, each spike with itself included.

    A spike meets the spikes of its own and the next bucket of the window's width.
    """
    b = F.floor(F.col("t_s") / window)
    left = spikes.select(*keys, F.col("t_s").alias("ta"), F.col("pos_i").alias("ia"), F.explode(F.array(b, b + 1)).alias("__b"))
    right = spikes.select(*keys, F.col("t_s").alias("tb"), F.col("pos_i").alias("ib"), b.alias("__b"))
    lag = F.col("tb") - F.col("ta")
    near = (lag <= window) if inclusive else (lag < window)
    return left.join(right, [*keys, "__b"]).where((F.col("ib") >= F.col("ia")) & near).select(*keys, "ia", "ib", lag.alias("lag"))


def as_of_linear(grid: DataFrame, samples: DataFrame, value: str, to: str) -> DataFrame:
    """``grid.t_s`` with ``value`` interpolated linearly between the samples around it; null outside them."""
    known = samples.select("t_s", F.struct("t_s", F.col(value).cast("double").alias("v")).alias("s"), F.lit(False).alias("own"))
    both = grid.select("t_s", F.lit(None).cast("struct<t_s:double,v:double>").alias("s"), F.lit(True).alias("own")).unionByName(known)
    # the order column of a chunked window: time in microseconds, samples before grid points
    ordered = both.withColumn("__o", F.round(F.col("t_s") * 1e6).cast("long") * 2 + F.col("own").cast("int"))
    ordered = last_known(ordered, F.col("s"), "a", order="__o", chunk=_SPAN)
    later = ordered.withColumn("__o", F.round(F.col("t_s") * 1e6).cast("long") * 2 + 1 - F.col("own").cast("int"))
    out = last_known(later, F.col("s"), "b", order="__o", ahead=True, chunk=_SPAN).where("own")
    a, b = F.col("a"), F.col("b")
    line = a["v"] + (b["v"] - a["v"]) * F.coalesce(ratio(F.col("t_s") - a["t_s"], b["t_s"] - a["t_s"]), F.lit(0.0))
    return out.select("t_s", line.alias(to))


#: Targets that :func:`nearest_point` takes.
TARGETS = 10_000


def nearest_point(points: DataFrame, targets: DataFrame, distance: Callable[[Column], Column], name: str) -> DataFrame:
    """Each point with ``to, distance`` of its nearest of a few ``targets`` (a map's peaks), ties to the smaller name.

    ``distance`` gives a column from a target, a struct of its columns, and the
    point's own columns. At most TARGETS are taken, more raise an error: they are
    broadcast as one row, and each point is compared with all where it lies.
    Without any target there is no row.
    """
    if targets.limit(TARGETS + 1).count() > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    every = targets.agg(F.collect_list(F.struct(*targets.columns)).alias("__targets"))
    near = F.array_min(F.transform("__targets", lambda t: F.struct(distance(t).alias("distance"), t[name].alias("to"))))
    found = points.crossJoin(F.broadcast(every)).withColumn("__near", near).where("__near is not null")  # one row
    return found.select(*points.columns, "__near.to", "__near.distance")
