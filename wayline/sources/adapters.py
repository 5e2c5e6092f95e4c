"""Canonical tables derived from tables of other kinds, by simple deterministic rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FS = 50.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, t_s, tet, cell, v, k``: an event is a sample of a signal and a spike of its user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("i"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6).alias("t_s"),
        F.col("event_type").alias("tet"),
        F.col("user_id").alias("cell"),
        F.col("value").alias("v"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def positions(spark: SparkSession, sf_dir: str, masked: bool = False) -> DataFrame:
    """``i, x, y`` in cm, a sample an event; masked: null where the signal is below 10."""
    e = events(spark, sf_dir)
    seen = F.col("v") >= 10
    x, y = F.least("v", F.lit(100.0)), F.col("k").cast("double")
    return e.select("i", (F.when(seen, x) if masked else x).alias("x"), (F.when(seen, y) if masked else y).alias("y"))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tet, cell, t_s, pos_i``."""
    return events(spark, sf_dir).select("tet", "cell", "t_s", F.col("i").alias("pos_i"))


#: The same rules in SQL, as the first common table expressions of an oracle.
SQL = """WITH ev AS (
    SELECT event_id AS i, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t_s, event_type AS tet, user_id AS cell,
           value AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
), pos AS (SELECT i, least(v, 100.0) AS x, k::DOUBLE AS y FROM ev
), mpos AS (SELECT i, CASE WHEN v >= 10 THEN least(v, 100.0) END AS x, CASE WHEN v >= 10 THEN k::DOUBLE END AS y FROM ev
), kin AS (
    SELECT i, x, y, coalesce(sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) * 50.0, 0) AS speed,
           atan2(coalesce(lead(x) OVER w - x, 0), coalesce(lead(y) OVER w - y, 0)) AS dir
    FROM pos WINDOW w AS (ORDER BY i)
)"""
