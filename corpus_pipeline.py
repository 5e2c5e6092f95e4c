"""The corpus pipeline: documents in, token ids of what is worth training on out.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is
written and reread as the next one's ``docs``. All but the last return the
columns of ``documents``; rows whose ``doc_id`` is null or repeats are kept as
rows wherever a stage does not reject them by what they hold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import byte_bpe, decontaminate, langid, line_dedup, simhash
from wayline.storage import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Sets of rejected rows up to this size are broadcast (16 bytes each), larger ones joined by shuffle.
SMALL = 1_000_000
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _key() -> list:
    """Names a row by its id and text, nulls included."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")]


def _without(docs: DataFrame, rejected: DataFrame, on: list[str]) -> DataFrame:
    """``docs`` without the rows that ``rejected`` names; texts are shuffled only if that is large."""
    rejected = materialize(rejected.distinct(), "rejected")
    return docs.join(F.broadcast(rejected) if rejected.count() <= SMALL else rejected, on, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in none of the corpus's languages or whose language stays open.

    The model is trained on all distinct texts by the documents' own ``lang``; the
    evidence is the text, ``lang`` as what is declared, and ``source`` as the host.
    Rows that repeat fare alike; a null or empty text is judged by what is declared
    and its host alone, so it goes where those say nothing. An empty table stays empty.
    """
    model = langid.train(docs)
    keyed = docs.select("*", *_key())
    found = langid.identify(keyed, model, keys=("k1", "k2"), declared="lang", host="source")
    return _without(keyed, found.where("not accepted").select("k1", "k2"), ["k1", "k2"]).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from texts; every row stays, with null texts as empty ones.

    Rows of one id count as one document; see :func:`line_dedup.dedup_lines`.
    """
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keeps the document with the smallest id.

    Rows without an id can't be named and stay. Where an id repeats, each of its
    texts is judged by itself. Should the kept id repeat, its rows with one text
    are one row.
    """
    keyed = docs.select("*", *_key())
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "k1", "k2"))  # ordered by doc_id first
    found = simhash.near_duplicates(keyed.select(own.alias("own"), "text"), id_col="own")
    groups = materialize(found.select("own.*", F.col("component_id.doc_id").alias("component_id")), "groups")
    left = _without(keyed, groups.where("doc_id <> component_id").select("k1", "k2"), ["k1", "k2"])
    twice = materialize(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left.select(*COLUMNS)
    once = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy, whole or edited, of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    keyed = docs.select("*", *_key())
    leaks = decontaminate.find_leaks(keyed, items, keys=("k1", "k2"), n=1)
    return _without(keyed, leaks.select("k1", "k2"), ["k1", "k2"]).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens`` and digests of the ids and of the bytes they decode to, for each row.

    A null or empty text has no ids.
    """
    return byte_bpe.round_trip(docs.select("doc_id", "text"), VOCABULARY, PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: SQL can express neither the trigram models nor the alignments nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)  # a written stage goes as soon as the next is there; the input is none
    return STAGES[-1][1](spark, docs, sf_dir)
