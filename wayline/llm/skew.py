"""Joins with keys of which a few may hold a good part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys so frequent that there are at most this many for each shuffle partition go by broadcast.
HOT = 4


def uneven_join(rows: DataFrame, table: DataFrame, on: list[str], frequency: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one row a key, without its column ``frequency``.

    ``frequency`` says how many of the ``total`` rows have the key. Keys with more
    than a HOT-th part of a partition's share are broadcast: there can't be more
    than HOT for each shuffle partition. The others are joined by shuffle, so no
    task gets much more than its share. ``rows`` is read twice. Rows whose key is
    null or not in ``table`` stay in a left join alone.
    """
    much = total / (HOT * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = table.where(F.col(frequency) > much).drop(frequency)
    rest = table.where(F.col(frequency) <= much).drop(frequency)
    found = rows.join(F.broadcast(hot), on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return found.unionByName(others)
