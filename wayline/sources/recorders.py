"""Recordings of other systems, from files converted to Parquet, as the canonical tables.

Conversion keeps the names of the original's fields; a vector becomes a column, in
order of ``i``. What a reader can't find it names in an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.sources import mat_files
from wayline.sources.catalog import resampled


def _first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first known value of those of some columns that a table has."""
    return F.coalesce(F.lit(None), *[F.col(n) for n in names if n in df.columns])


# -- probes with many sites: tables spk, pos, lfp, reward in one folder ----------


def probe_spikes(spark: SparkSession, folder: str) -> DataFrame:
    """``tet, cell, t_s, pos_i``: ``times, posSample, clu``; there is one tetrode, 1."""
    s = spark.read.parquet(f"{folder}/spk")
    return s.select(F.lit(1).alias("tet"), F.col("clu").cast("int").alias("cell"), F.col("times").cast("double").alias("t_s"), F.col("posSample").cast("long").alias("pos_i"))


def probe_positions(spark: SparkSession, folder: str) -> DataFrame:
    """``i, t_s, x, y, speed, dir``, all as stored."""
    p = spark.read.parquet(f"{folder}/pos")
    return p.select(F.col("i").cast("long").alias("i"), F.col("times").cast("double").alias("t_s"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "speed", "dir")])


def probe_cells(spark: SparkSession, folder: str) -> DataFrame:
    """``tet, cell`` of every cluster but noise (0)."""
    return probe_spikes(spark, folder).select("tet", "cell").distinct().where("cell <> 0")


def probe_trial(spark: SparkSession, folder: str) -> DataFrame:
    """``duration_s, n_pos, pos_fs, eeg_fs, w, h`` in one row: from the first position to the last.

    The field signal's rate is one over its mean interval, to a whole number; the
    position's rate and the arena come from the file's settings.
    """
    p = probe_positions(spark, folder).agg((F.max("t_s") - F.min("t_s")).alias("duration_s"), F.count("*").alias("n_pos"))
    t = spark.read.parquet(f"{folder}/lfp").agg(F.round((F.count("times") - 1) / (F.max("times") - F.min("times"))).alias("eeg_fs"))
    s = spark.read.parquet(f"{folder}/settings").limit(1)
    s = s.select(*[F.col(c).cast("double").alias(to) for c, to in (("posSampRate", "pos_fs"), ("RightBorder", "w"), ("TopBorder", "h"))])
    return p.crossJoin(t).crossJoin(s).select("duration_s", "n_pos", "pos_fs", "eeg_fs", "w", "h")  # one row each


def reward_trials(rewards: DataFrame, start_s: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``trial, x, y, offset_s, fixed, start_s, end_s, trial_n, duration_s`` of rewards ``t_s, x, y``.

    The fixed place is the most frequent ``x`` (of equally frequent ones the
    smallest); ``offset`` counts rewards since, or if negative until, the nearest
    fixed one, ties to the earlier; a trial begins where the one before ended.
    ``trial_n`` counts from 1 to 4 from three before a fixed reward. A session has
    few rewards.
    """
    from pyspark.sql import Window

    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    by = whole.orderBy("t_s")
    often = rewards.groupBy(*keys, "x").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("m")).select(*keys, F.col("m.x").alias("__x"))
    r = rewards.join(often, list(keys)) if keys else rewards.crossJoin(F.broadcast(often))
    r = r.withColumns({"trial": F.row_number().over(by) - 1, "fixed": F.col("x") == F.col("__x")}).drop("__x")
    at = F.when(F.col("fixed"), F.col("trial"))
    before = F.last(at, True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(at, True).over(whole.orderBy(F.desc("t_s")).rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumns({"__a": F.col("trial") - before, "__b": after - F.col("trial")})
    offset = F.when(F.col("__b").isNull() | (F.col("__a") <= F.col("__b")), F.col("__a")).otherwise(-F.col("__b"))
    start = F.coalesce(F.lag("t_s").over(by), F.lit(start_s))
    r = r.withColumns({"offset": offset, "start_s": start, "end_s": F.col("t_s")})
    made = {"trial_n": F.pmod(F.col("offset") + 3, F.lit(4)) + 1, "duration_s": F.col("end_s") - F.col("start_s")}
    return r.withColumns(made).select(*keys, "trial", "x", "y", "offset", "fixed", "start_s", "end_s", "trial_n", "duration_s")


# -- single files for position, field signal and each cell ----------------------


def _table(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """The vectors of a MATLAB file of level 5, or of its converted form, as columns."""
    return mat_files.columns(spark, path, names) if path.endswith(".mat") else spark.read.parquet(path)


def lab_positions(spark: SparkSession, path: str, fs: float = 50.0, tolerance: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Positions ``i, t_s, x, y`` at a fixed rate from ``post, posx, posy``, and one row on the file's own times.

    That row is ``duration_s`` (the last time and a mean interval), ``w, h`` (the
    largest x and y) and ``uneven`` (an interval differs by more than ``tolerance``).
    """
    raw = _table(spark, path, ("post", "posx", "posy")).select(F.col("post").cast("double").alias("t_s"), F.col("posx").cast("double").alias("x"), F.col("posy").cast("double").alias("y"))
    raw = raw.select("t_s", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y")])
    pos = resampled(raw, fs)
    size = pos.agg(F.max("x").alias("w"), F.max("y").alias("h"))
    own = raw.agg(F.max("t_s").alias("b"), F.min("t_s").alias("a"), F.count("t_s").alias("n"))
    step = (F.col("b") - F.col("a")) / (F.col("n") - 1)
    off = raw.crossJoin(F.broadcast(own)).agg(F.max(F.abs((F.col("t_s") - F.col("a")) / step - F.round((F.col("t_s") - F.col("a")) / step)) * step).alias("off"))
    info = own.crossJoin(off).crossJoin(size).select((F.col("b") + step).alias("duration_s"), "w", "h", (F.col("off") > tolerance).alias("uneven"))
    return pos, info


def lab_field_signal(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """``i, v`` and the rate from ``EEG`` and ``fs`` or ``Fs``."""
    m = _table(spark, path, ("EEG", "fs", "Fs"))
    rate = m.select(_first_of(m, ("fs", "Fs")).cast("double").alias("fs")).where("fs is not null").first()
    if rate is None:
        raise ValueError("the file names no rate")
    return m.where("EEG is not null").select(F.col("i").cast("long").alias("i"), F.col("EEG").cast("double").alias("v")), rate.fs


def lab_spikes(spark: SparkSession, path: str, tet: int, cell: int, fs: float = 50.0) -> DataFrame:
    """``tet, cell, t_s, pos_i`` of one cell's file, whose times are in ``ts``, ``cellTS`` or ``cellTs``."""
    m = _table(spark, path, ("ts", "cellTS", "cellTs"))
    t = _first_of(m, ("ts", "cellTS", "cellTs")).cast("double")
    return m.select(F.lit(tet).alias("tet"), F.lit(cell).alias("cell"), t.alias("t_s"), F.floor(t * fs).alias("pos_i")).where("t_s is not null")
