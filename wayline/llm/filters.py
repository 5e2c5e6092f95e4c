"""Filters that spare a shuffle most of the rows that its join would drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each key it is made of, and the most it may have: 2 MB of bits, some 16 MB as Spark broadcasts them.
BITS_PER_KEY, MOST_BITS = 16, 1 << 24


def _filter(known: DataFrame, keys: list[str], n_known: int) -> tuple:
    """A table of words of bits that the keys of ``known`` set, the column that finds a row's word, and that of its bit."""
    bits = 64
    while bits < min(MOST_BITS, BITS_PER_KEY * n_known):
        bits *= 2
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    word, mark = F.shiftright(at, 6).alias("__word"), F.expr(f"shiftleft(1L, int(pmod(xxhash64({', '.join(keys)}), 64)))")
    words = known.select(word, mark.alias("__m")).groupBy("__word").agg(F.bit_or("__m").alias("__bits"))  # MOST_BITS / 64 rows at most
    return words, word, mark


def may_hold(rows: DataFrame, known: DataFrame, keys: list[str], n_known: int) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not in ``known``, which has ``n_known`` rows.

    Keys set bits by their hash, and those bits are broadcast. Beyond some ten
    million keys the filter fills up, and the join that follows does all the work.
    """
    words, word, mark = _filter(known, keys, n_known)
    met = rows.select("*", word).join(F.broadcast(words), "__word")
    return met.where(F.col("__bits").bitwiseAND(mark) != 0).drop("__word", "__bits")


def mark_held(rows: DataFrame, known: DataFrame, keys: list[str], n_known: int, to: str) -> DataFrame:
    """``rows`` with ``to``: false where their ``keys`` are not in ``known``, true where they are and for a few others."""
    words, word, mark = _filter(known, keys, n_known)
    met = rows.select("*", word).join(F.broadcast(words), "__word", "left")
    return met.withColumn(to, F.coalesce(F.col("__bits").bitwiseAND(mark) != 0, F.lit(False))).drop("__word", "__bits")
