"""Operators over one long ordered series.

A window over the whole series would sort it in one task. Here a series is cut
into chunks of its order column; windows run within chunks, and what crosses a
border comes either from a halo of neighbouring rows or from a table of one row
for each chunk. ``keys`` name the series, where there are several.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wayline.functions.circular import direction, ratio
from wayline.storage import discard, materialize

CHUNK = 1 << 16


def _chunk(order: str, chunk: float) -> Column:
    return F.floor(F.col(order) / F.lit(chunk))


def framed(df: DataFrame, columns: dict[str, Callable[[WindowSpec], Column]], before: int, after: int, keys: tuple[str, ...] = (), order: str = "i", chunk: int = CHUNK) -> DataFrame:
    """``df`` with columns that look at most ``before`` rows back and ``after`` rows ahead of a dense order."""
    home = F.struct(_chunk(order, chunk).alias("__c"), F.lit(True).alias("__home"))
    at = [home]
    if before:
        at.append(F.when(F.pmod(F.col(order), F.lit(chunk)) >= chunk - before, F.struct((_chunk(order, chunk) + 1).alias("__c"), F.lit(False).alias("__home"))))
    if after:
        at.append(F.when(F.pmod(F.col(order), F.lit(chunk)) < after, F.struct((_chunk(order, chunk) - 1).alias("__c"), F.lit(False).alias("__home"))))
    wide = df.select("*", F.inline(F.filter(F.array(*at), lambda s: s.isNotNull())))
    w = Window.partitionBy(*keys, "__c").orderBy(order)
    return wide.withColumns({name: f(w) for name, f in columns.items()}).where("__home").drop("__c", "__home")


def _with_carry(df: DataFrame, end: Column, carried: Callable[[WindowSpec], Column], keys: tuple[str, ...], order: str, chunk: int) -> DataFrame:
    """``df`` with its chunk ``__c`` and ``__carry``, what ``carried`` makes of the ``__end`` of the chunks before."""
    cut = df.withColumn("__c", _chunk(order, chunk))
    ends = cut.groupBy(*keys, "__c").agg(end.alias("__end"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__c")
    ends = ends.select(*keys, "__c", carried(over).alias("__carry"))
    return cut.join(ends, [*keys, "__c"], "left")


def running_sum(df: DataFrame, value: Column, to: str, keys: tuple[str, ...] = (), order: str = "i", chunk: int = CHUNK) -> DataFrame:
    """Sum of ``value`` up to and including each row; a null adds nothing."""
    v = F.coalesce(value, F.lit(0))
    out = _with_carry(df.withColumn("__v", v), F.sum("__v"), lambda w: F.sum("__end").over(w.rowsBetween(Window.unboundedPreceding, -1)), keys, order, chunk)
    w = Window.partitionBy(*keys, "__c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(to, F.sum("__v").over(w) + F.coalesce("__carry", F.lit(0))).drop("__v", "__c", "__carry")


def previous(df: DataFrame, value: Column, to: str, keys: tuple[str, ...] = (), order: str = "i", chunk: int = CHUNK) -> DataFrame:
    """``value`` of the row before, null for the first; the order need not be dense."""
    boxed = df.withColumn("__v", F.struct(value.alias("v")))
    out = _with_carry(boxed, F.max_by("__v", order), lambda w: F.lag("__end").over(w), keys, order, chunk)
    w = Window.partitionBy(*keys, "__c").orderBy(order)
    return out.withColumn(to, F.coalesce(F.lag("__v").over(w), F.col("__carry"))["v"]).drop("__v", "__c", "__carry")


def last_known(df: DataFrame, value: Column, to: str, keys: tuple[str, ...] = (), order: str = "i", ahead: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The last ``value`` that is not null up to a row, or, if ``ahead``, the next from it on."""
    boxed = df.withColumn("__v", value)
    pick = F.min_by if ahead else F.max_by
    end = pick("__v", F.when(F.col("__v").isNotNull(), F.col(order)))
    # ahead means backwards: a frame that only grows is kept up row by row, one that shrinks is made anew for each
    by = F.desc if ahead else F.asc

    def carried(w: WindowSpec) -> Column:
        return F.last("__end", True).over(w.orderBy(by("__c")).rowsBetween(Window.unboundedPreceding, -1))

    out = _with_carry(boxed, end, carried, keys, order, chunk)
    w = Window.partitionBy(*keys, "__c").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(to, F.coalesce(F.last("__v", True).over(w), F.col("__carry"))).drop("__v", "__c", "__carry")


def zscore(df: DataFrame, value: str, to: str = "z") -> DataFrame:
    """Distance from the mean in population standard deviations; null if they are 0."""
    whole = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.crossJoin(F.broadcast(whole)).withColumn(to, ratio(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def islands(df: DataFrame, mask: Column, to: str = "label", order: str = "i") -> DataFrame:
    """Numbers the runs of consecutive rows where ``mask`` holds from 1; 0 elsewhere."""
    marked = df.withColumn("__m", F.coalesce(mask, F.lit(False)))
    marked = previous(marked, F.col("__m"), "__p", order=order)
    start = (F.col("__m") & ~F.coalesce("__p", F.lit(False))).cast("int")
    return running_sum(marked, start, "__n", order=order).withColumn(to, F.when(F.col("__m"), F.col("__n")).otherwise(0).cast("long")).drop("__m", "__p", "__n")


def segmented_sum(df: DataFrame, value: Column, label: str, to: str, keys: tuple[str, ...] = (), order: str = "i") -> DataFrame:
    """Sum of ``value`` since the run of equal labels began; null where the label is 0.

    A run may be as long as the series: sums of the whole, less what stood before the run.
    """
    out = previous(df, F.col(label), "__p", keys, order)
    out = running_sum(out.withColumn("__x", F.coalesce(value.cast("double"), F.lit(0.0))), F.col("__x"), "__s", keys, order)
    begins = F.col("__p").isNull() | (F.col("__p") != F.col(label))
    out = last_known(out, F.when(begins, F.col("__s") - F.col("__x")), "__0", keys, order)
    return out.withColumn(to, F.when(F.col(label) != 0, F.col("__s") - F.col("__0"))).drop("__p", "__x", "__s", "__0")


def label_changes(df: DataFrame, label: str, to: str, keys: tuple[str, ...] = (), order: str = "i", least: int = 1) -> DataFrame:
    """Numbers the runs of one label other than 0, neighbours of another label being runs of their own.

    Runs shorter than ``least`` rows are 0 and the rest numbered without gaps.
    """
    before = previous(df, F.col(label), "__p", keys, order)
    inside = F.coalesce(F.col(label), F.lit(0)) != 0
    begins = inside & ~F.col("__p").eqNullSafe(F.col(label))
    runs = running_sum(before, begins.cast("int"), "__n", keys, order).withColumn("__n", F.when(inside, F.col("__n")).otherwise(0)).drop("__p")
    long = runs.where("__n > 0").groupBy(*keys, "__n").agg(F.count("*").alias("__size"), F.min(order).alias("__first")).where(F.col("__size") >= least)
    numbered = running_sum(long, F.lit(1), to, keys, "__first").select(*keys, "__n", F.col(to).cast("long").alias(to))
    return runs.join(numbered, [*keys, "__n"], "left").withColumn(to, F.coalesce(to, F.lit(0).cast("long"))).drop("__n")


#: Rows among which a percentile is looked for by counting values.
FEW = 200_000


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Percentiles of a whole column, interpolated between the two values around each; nulls don't count.

    Bounds from Spark's approximate percentiles close in on each value, rows
    between them being counted, until few are left: no task sorts the column.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None for _ in shares]

    def ranked(k: int) -> float:
        a, b, below, inside = low, high, 0, n  # a <= value <= b; rows below a; rows from a to b
        while inside > FEW and a < b:
            part = rows.where(F.col("v").between(a, b))
            at = (k - below) / inside
            near = [max(0.0, at - 0.001), min(1.0, at + 0.001)]
            p, q = part.agg(F.percentile_approx("v", near, 10_000)).first()[0]
            p, q = (a if near[0] == 0 else p), (b if near[1] == 1 else q)
            less, some = part.agg(F.count_if(F.col("v") < p), F.count_if(F.col("v").between(p, q))).first()
            if not below + less <= k < below + less + some or some == inside:
                break
            a, b, below, inside = p, q, below + less, some
        counts = rows.where(F.col("v").between(a, b)).groupBy("v").count()
        up_to = running_sum(counts.withColumn("__o", F.col("v")), F.col("count"), "c", order="__o", chunk=max((b - a) / 64, 5e-324) if b > a else 1.0)
        return up_to.where(F.col("c") > k - below).agg(F.min("v")).first()[0]

    out = []
    for share in shares:
        at = share * (n - 1)
        k = math.floor(at)
        first = ranked(k)
        out.append(first if at == k else first + (ranked(k + 1) - first) * (at - k))
    return out


def close_gaps(spans: DataFrame, length: int, first: str = "first_i", last: str = "last_i", to: str = "event") -> DataFrame:
    """Numbers spans so that neighbours with less than ``length`` samples between them share a number."""
    before = previous(spans, F.col(last), "__e", order=first)
    apart = (F.col("__e").isNull() | (F.col(first) - F.col("__e") - 1 >= length)).cast("int")
    return running_sum(before, apart, to, order=first).withColumn(to, F.col(to).cast("long")).drop("__e")


def interpolate(df: DataFrame, column: str, to: str, order: str = "i", keys: tuple[str, ...] = ()) -> DataFrame:
    """Linear between the nearest known samples, constant beyond the first and last."""
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("i"), F.col(column).alias("v")))
    out = last_known(last_known(df, known, "__a", keys, order), known, "__b", keys, order, ahead=True)
    a, b = F.col("__a"), F.col("__b")
    between = a["v"] + (b["v"] - a["v"]) * ratio(F.col(order) - a["i"], b["i"] - a["i"])
    return out.withColumn(to, F.coalesce(F.col(column), between, a["v"], b["v"])).drop("__a", "__b")


def kinematics(pos: DataFrame, fs: float) -> DataFrame:
    """``pos`` with ``speed`` (cm/s, 0 for the last sample) and ``dir`` (of the displacement, x first)."""
    step = framed(pos, {"__dx": lambda w: F.lead("x").over(w) - F.col("x"), "__dy": lambda w: F.lead("y").over(w) - F.col("y")}, 0, 1)
    dx, dy = F.col("__dx"), F.col("__dy")
    speed = F.coalesce(F.sqrt(dx * dx + dy * dy) * fs, F.lit(0.0))
    return step.withColumns({"speed": speed, "dir": direction(F.coalesce(dx, F.lit(0.0)), F.coalesce(dy, F.lit(0.0)))}).drop("__dx", "__dy")


def path_length(pos: DataFrame) -> DataFrame:
    """Path length up to each sample; a step at a masked sample adds nothing."""
    step = framed(pos, {"__d": lambda w: F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))}, 1, 0)
    return running_sum(step, F.col("__d"), "path").drop("__d")


def local_maxima(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is above that of both neighbours."""
    near = framed(df, {"__a": lambda w: F.lag(value).over(w), "__b": lambda w: F.lead(value).over(w)}, 1, 1)
    return near.where((F.col(value) > F.col("__a")) & (F.col(value) > F.col("__b"))).drop("__a", "__b")


def crossings(df: DataFrame, value: str, level: float, up: bool = True) -> DataFrame:
    """``i, at``: where the series crosses a level, interpolated between samples."""
    near = framed(df, {"__b": lambda w: F.lead(value).over(w)}, 0, 1)
    a, b = F.col(value), F.col("__b")
    hit = (a <= level) & (b > level) if up else (a >= level) & (b < level)
    return near.where(hit).select("i", (F.col("i") + (F.lit(level) - a) / (b - a)).alias("at"))


def smooth(df: DataFrame, value: str, weights: list[float], to: str, edge: str = "reflect") -> DataFrame:
    """Weighted sum over a centred window.

    Beyond its ends the series is reflected (the end sample repeats), or, if
    ``edge`` is ``nearest``, goes on with its end samples.
    """
    r = len(weights) // 2
    n = df.agg((F.max("i") + 1).alias("__n"))
    ends = df.crossJoin(F.broadcast(n))
    own = F.array(F.struct(F.col("i").alias("j"), F.lit(True).alias("own")))
    other = lambda j: F.struct(j.cast("long").alias("j"), F.lit(False).alias("own"))
    none = F.array().cast("array<struct<j:bigint,own:boolean>>")
    if edge == "reflect":  # as often as it takes to fill r samples
        turns = F.sequence(F.lit(-1).cast("bigint") - F.floor(F.lit(r) / F.col("__n")), F.floor(F.lit(r) / F.col("__n")) + 1)
        copies = F.flatten(F.transform(turns, lambda t: F.array(t * 2 * F.col("__n") + F.col("i"), t * 2 * F.col("__n") - 1 - F.col("i"))))
        near = F.filter(copies, lambda j: (j >= -r) & (j < F.col("__n") + r) & ~j.between(F.lit(0), F.col("__n") - 1))
        spread = F.when((F.col("i") < r) | (F.col("i") >= F.col("__n") - r), F.transform(near, other)).otherwise(none)
    else:
        low = F.when((F.col("i") == 0) & (F.lit(r) > 0), F.transform(F.sequence(F.lit(-r).cast("bigint"), F.lit(-1).cast("bigint")), other)).otherwise(none)
        high = F.when((F.col("i") == F.col("__n") - 1) & (F.lit(r) > 0), F.transform(F.sequence(F.col("__n"), F.col("__n") + r - 1), other)).otherwise(none)
        spread = F.concat(low, high)
    mirrored = ends.select("*", F.inline(F.concat(own, spread)))

    def total(w: WindowSpec) -> Column:
        parts = [F.lit(x) * (F.lag(value, -k) if k <= 0 else F.lead(value, k)).over(w) for k, x in zip(range(-r, r + 1), weights)]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    return framed(mirrored, {to: total}, r, r, order="j", chunk=max(CHUNK, r + 1)).where("own").drop("__n", "j", "own")


def boxcar(df: DataFrame, value: str, width: int, to: str, keys: tuple[str, ...]) -> DataFrame:
    """Mean of ``width`` samples around each, the end samples repeated; an even width reaches further back. ``i`` is dense from 0."""
    back, on = width // 2, width - width // 2 - 1
    ends = df.groupBy(*keys).agg(F.min_by(value, "i").alias("__f"), F.max_by(value, "i").alias("__l"), F.max("i").alias("__m"))
    near = framed(df, {"__s": lambda w: F.sum(value).over(w.rowsBetween(-back, on))}, back, on, keys).join(ends, list(keys))
    missing = F.greatest(back - F.col("i"), F.lit(0)) * F.col("__f") + F.greatest(F.col("i") + on - F.col("__m"), F.lit(0)) * F.col("__l")
    return near.withColumn(to, (F.col("__s") + missing) / width).drop("__s", "__f", "__l", "__m")


def scan_chunks(
    df: DataFrame,
    keys: tuple[str, ...],
    order: str,
    step: Callable[[pd.DataFrame, np.ndarray | None], tuple[dict[str, list], np.ndarray | None]],
    made: dict[str, str],
    chunk: int,
    overlap: int,
    ahead: bool = False,
    tolerance: float = 0.0,
) -> DataFrame:
    """``keys, order`` and the columns ``made`` of a recurrence that soon forgets where it began, its chunks side by side.

    ``step(rows, state)`` takes consecutive rows of one series and the state before
    them, an array of numbers or None at its start, and gives the columns and the
    next state. Each chunk runs from ``overlap`` places before it, without a state;
    what it has come to when it enters the chunk is compared with where the chunk
    before ended. A chunk for which they are further apart than ``tolerance`` runs
    again from there, and so on until all agree, so the result is that of one run
    through. At worst, if nothing is ever forgotten, there is a round for each chunk.
    ``ahead`` runs from the end.
    """
    names = list(keys)
    at = F.col(order)
    c, place = F.floor(at / F.lit(chunk)), F.pmod(at, F.lit(chunk))
    near = place < overlap if ahead else place >= chunk - overlap
    home = F.struct(c.alias("__c"), F.lit(True).alias("__home"))
    beside = F.when(near, F.struct((c - 1 if ahead else c + 1).alias("__c"), F.lit(False).alias("__home")))
    # a series of few rows is one chunk, of number 0, and a task takes many of them
    sizes = df.groupBy(*names).agg(F.count("*").alias("__rows"))
    n = sizes.agg(F.sum("__rows")).first()[0] or 0
    if names:
        long = sizes.where(F.col("__rows") > chunk).select(*names, F.lit(True).alias("__long"))  # one of ``chunk`` rows at most
        marked = df.join(F.broadcast(long), names, "left").withColumn("__long", F.coalesce("__long", F.lit(False)))
    else:
        marked = df.withColumn("__long", F.lit(n > chunk))
    one = F.array(F.struct(F.lit(0).cast("long").alias("__c"), F.lit(True).alias("__home")))
    cut = marked.select("*", F.inline(F.when(F.col("__long"), F.filter(F.array(home, beside), lambda s: s.isNotNull())).otherwise(one)))
    by_key = F.xxhash64(*names) if names else F.lit(0).cast("long")
    dealt = F.when(F.col("__long"), by_key).otherwise(F.pmod(by_key, F.lit(n // chunk + 1)))
    cut = cut.withColumn("__task", dealt).drop("__long")
    kept = [*names, order]
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in kept] + [f"{k} {t}" for k, t in made.items()]
    state = "array<double>"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        """The chunks of one number of one or many series."""
        g = g.sort_values([*names, order], ascending=[True] * len(names) + [not ahead], ignore_index=True)
        series = g.groupby(names, sort=False, dropna=False).ngroup().to_numpy() if names else np.zeros(len(g), int)
        first = np.flatnonzero(np.diff(series, prepend=-1))
        home, starts = g["__home"].to_numpy(bool), g["__start"].tolist() if "__start" in g else None
        columns = {k: np.empty(len(g), object) for k in [*made, "__before", "__after"]}
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(g)]):
            before = None if starts is None or starts[a] is None else np.asarray(starts[a], float)
            inner = int(home[a:b].argmax()) if home[a:b].any() else b - a  # what leads up to the chunk comes first
            if inner:
                before = step(g.iloc[a : a + inner], before)[1]
            if a + inner == b:
                continue
            values, after = step(g.iloc[a + inner : b], before)
            for k, v in values.items():
                for at, x in enumerate(v, a + inner):
                    columns[k][at] = x
            columns["__before"][a + inner], columns["__after"][b - 1] = before, after
        return g[[*kept, "__c"]].assign(**columns)[home]

    schema = ", ".join([*kinds[: len(kept)], "__c bigint", *kinds[len(kept) :], f"__before {state}", f"__after {state}"])
    done = materialize(cut.groupBy("__task", "__c").applyInPandas(run, schema), "scanned")
    over = Window.partitionBy(*(names or [F.lit(0)])).orderBy(F.desc("__c") if ahead else F.asc("__c"))
    while True:
        ends = done.groupBy(*names, "__c").agg(F.first("__before", True).alias("b"), F.first("__after", True).alias("a"))
        ends = ends.select(*names, "__c", "b", F.lag("a").over(over).alias("__start"), F.row_number().over(over).alias("__n")).where("__n > 1")
        apart = F.array_max(F.zip_with("b", "__start", lambda x, y: F.abs(x - y)))
        same = F.coalesce(apart <= tolerance, F.col("b").isNull() & F.col("__start").isNull())
        wrong = materialize(ends.where(~same).select(*names, "__c", "__start"), "again")
        if wrong.isEmpty():
            return done.select(*kept, *made)
        again = cut.where("__home").join(wrong, [*names, "__c"]).groupBy("__task", "__c").applyInPandas(run, schema)
        after = materialize(done.join(wrong, [*names, "__c"], "left_anti").unionByName(again), "scanned")
        discard(done)
        done = after
