"""Candidate events in a signal: islands above its mean, selected, joined and measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.sequence import close_gaps, islands, zscore


def find_events(signal: DataFrame, value: str = "v", speed: str | None = None, peak: float = 3.0, max_speed: float = 10.0, close: int = 4, min_samples: int = 1) -> DataFrame:
    """``event, first_i, last_i, n_islands, z_peak, v_peak`` of a signal with a dense ``i``.

    Islands where the z-score is at least 0 are kept if their peak reaches
    ``peak`` and their largest ``speed`` is below ``max_speed`` (a missing speed
    rejects). Kept islands less than ``close`` samples apart are one event, which
    must be longer than ``min_samples``.
    """
    z = islands(zscore(signal, value), F.col("z") >= 0)
    v = F.col(speed).cast("double") if speed else F.lit(0.0)
    spans = z.where("label > 0").groupBy("label").agg(
        F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.max("z").alias("z_peak"), F.max(v).alias("v_peak"), F.max(v.isNull()).alias("gap")
    )
    kept = spans.where((F.col("z_peak") >= peak) & (F.col("v_peak") < max_speed) & ~F.col("gap"))
    joined = close_gaps(kept, close).groupBy("event").agg(
        F.min("first_i").alias("first_i"), F.max("last_i").alias("last_i"), F.count("*").alias("n_islands"), F.max("z_peak").alias("z_peak"), F.max("v_peak").alias("v_peak")
    )
    return joined.where(F.col("last_i") - F.col("first_i") + 1 > min_samples)
