"""Arrow batches of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows handed to a Python worker at once: texts are a few kB each, and workers share small executors.
ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; lowers the session's Arrow batch to ROWS where it is larger. A lower setting is left alone."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_KEY)) <= ROWS:
        conf.set(_KEY, ROWS)
    return df
