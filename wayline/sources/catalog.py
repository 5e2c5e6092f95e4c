"""Catalogues of sessions, tables converted from other formats, and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayline.operators import joins

#: Fixed columns of the catalogue file, which has no header.
COLUMNS = "Animal string, RecordLocs string, ExperimentN int, Trial1 string, BoxSize1 string, Trial2 string, VBoxSize2 string, Trial3 string, VBoxSize3 string, FixedRewardModulus string"


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue file with ``E1inCA1`` and ``E2inCA1``: whether a location's letter is C. Rows whose animal is no number go; in order of animal."""
    rows = spark.read.schema(COLUMNS).csv(path)
    animal = F.col("Animal").try_cast("double").cast("int")
    rows = rows.withColumn("Animal", animal.cast("string")).where("Animal is not null")
    rows = rows.withColumns({"E1inCA1": F.substring("RecordLocs", 1, 1) == "C", "E2inCA1": F.substring("RecordLocs", 2, 1) == "C"})
    return rows.orderBy(F.col("Animal").cast("int"))


def sessions(listing: DataFrame) -> DataFrame:
    """``Animal, DateTime, Year, Month, Day`` of a listing of ``animal/yyyy-mm-dd/...``; other paths are left out."""
    where = F.regexp_extract("path", r"([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]+$", 1)
    day = F.try_to_date(F.regexp_extract("path", r"([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]+$", 2), "yyyy-MM-dd")
    found = listing.select(where.alias("Animal"), day.alias("DateTime")).where("DateTime is not null").distinct()
    return found.select("*", F.year("DateTime").alias("Year"), F.month("DateTime").alias("Month"), F.dayofmonth("DateTime").alias("Day"))


def resolve(catalog: DataFrame, animal: str, year: int | None = None, month: int | None = None, day: int = 0) -> DataFrame:
    """An animal's sessions of a date, or, without year and month, of ``day`` (0 or less) days from today. Years below 100 are of this century."""
    if (year is None) != (month is None):
        raise ValueError("year and month go together")
    if year is None:
        if day > 0:
            raise ValueError("an offset in days is 0 or less")
        date = F.date_add(F.current_date(), day)
    else:
        date = F.make_date(F.lit(year + 2000 if year < 100 else year), F.lit(month), F.lit(day))
    return catalog.where((F.col("Animal") == animal) & (F.col("DateTime") == date))


def session_name(animal: Column, year: Column, month: Column, day: Column, trial: Column) -> Column:
    """``animal-ddmmyytt``."""
    return F.format_string("%s-%02d%02d%02d%02d", animal, day, month, F.pmod(year, F.lit(1000)), trial)


def resampled(samples: DataFrame, fs: float = 50.0) -> DataFrame:
    """``i, t_s, x, y``: positions at a fixed rate, linear across what is missing, with the smallest x and y moved to 0.

    Where the first sample comes half to one and a half intervals after 0, time starts at 0 and the first position is null.
    """
    span = samples.agg(F.min("t_s").alias("a"), F.max("t_s").alias("b"), F.count("t_s").alias("n"))
    step = (F.col("b") - F.col("a")) / (F.col("n") - 1)
    start = F.when(F.col("a").between(step * 0.5, step * 1.5), F.lit(0.0)).otherwise(F.col("a"))
    grid = span.where("n > 1").select(start.alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - start) * fs + 1e-9))).alias("i"))
    grid = grid.select("i", (F.col("s") + F.col("i") / fs).alias("t_s"))
    x = joins.as_of_linear(grid.select("t_s"), samples.where("x is not null"), "x", "x")
    y = joins.as_of_linear(grid.select("t_s"), samples.where("y is not null"), "y", "y")
    out = grid.join(x, "t_s").join(y, "t_s")
    least = out.agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    return out.crossJoin(F.broadcast(least)).select("i", "t_s", (F.col("x") - F.col("__x")).alias("x"), (F.col("y") - F.col("__y")).alias("y"))


def save(df: DataFrame, path: str, keys: tuple[str, ...] = ("animal",)) -> None:
    """Results as Parquet, a folder for each value of the keys."""
    df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.partitionBy(*keys).mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """Stored results of the given keys; partitions of others are not read."""
    out = spark.read.parquet(path)
    for name, value in keys.items():
        out = out.where(F.col(name) == value)
    return out


def manifest(df: DataFrame) -> str:
    """The types of a table, nested ones included, as text."""
    return df.schema.json()


def restored(spark: SparkSession, path: str, text: str) -> DataFrame:
    """A stored table with the types of its manifest."""
    import json

    return spark.read.schema(StructType.fromJson(json.loads(text))).parquet(path)


def trial_of(catalog: DataFrame, animal: str, experiment: int) -> DataFrame:
    """The first row, by its trial, of an animal's experiment of a catalogue."""
    return catalog.where((F.col("Animal") == animal) & (F.col("ExperimentN") == experiment)).orderBy("Trial1").limit(1)
