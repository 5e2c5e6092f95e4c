"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined for each row: the likelihood of its text
under character-trigram models, the language that its markup declares, the suffix
of its address, and a prior of its host. Host priors are smoothed hierarchically,
host by registered domain by the whole; these and the tables of declared
languages and suffixes come from grouped counts over all rows, where a row counts
for the language that its text alone says. A row's own count is left out when
its evidence is weighed.

Besides the languages learned there is the class UNKNOWN, a uniform model, for
texts in none of them. Only letters count: numbers, addresses and the like are in
any language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.batches import small_batches
from wayline.llm.filters import mark_held
from wayline.storage import materialize

UNKNOWN = "und"
BITS = 15
#: Trigrams are not independent: a text's log likelihood is scaled down to that of at most so many.
EFFECTIVE = 50
#: Pseudo counts that a host takes from its domain and a domain from the whole.
KAPPA = 20.0
_SLICE = 1 << 20
#: Bytes of text that a task counts, at least where all cores have some: each gives up to a row for each trigram and language.
TASK_BYTES = 32 << 20
#: The uniform model's part in each language's model: a trigram never seen says little.
UNIFORM = 0.1
#: Bytes that stand for themselves, letters and what is beyond ASCII; all others are blanks.
_KEEP = np.array([b if chr(b).isalpha() or b > 127 else 32 for b in range(256)], np.uint8)


def _codes(text: str | None) -> Iterator[np.ndarray]:
    """Hashed trigrams of the UTF-8 bytes of a text in lower case, in slices; digits and signs are blanks, and no trigram spans one."""
    data = _KEEP[np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "surrogatepass"), np.uint8)]
    if not text:
        return
    for k in range(0, len(data) - 2, _SLICE):
        b = data[k : k + _SLICE + 2].astype(np.uint32)
        grams = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[b[1:-1] != 32]
        yield (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)


@dataclass
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # a row for each trigram bucket: log probability in each language

    def likelihoods(self, text: str | None) -> np.ndarray:
        """Scaled log likelihood in each language and, last, in the unknown one; zeros for an empty text."""
        total, n = np.zeros(len(self.languages)), 0
        for codes in _codes(text):
            total += self.logs[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return np.append(total, -n * BITS * math.log(2)) / (1 + n / EFFECTIVE)


def _distinct(rows: DataFrame) -> DataFrame:
    """The distinct ``text, lang`` of ``rows``, which have ``h``, a hash of the text; of texts only those that share a hash are shuffled."""
    repeated = materialize(rows.groupBy("lang", "h").count().where("count > 1").select("lang", "h"), "repeated")
    marked = mark_held(rows, repeated, ["lang", "h"], repeated.count(), "again")
    once, again = (marked.where(x).select("text", "lang") for x in ("not again", "again"))
    return once.unionByName(again.distinct())


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", max_rows: int | None = None, max_languages: int = 500) -> Model:
    """Trigram models from labelled rows: of each language all distinct texts, or some ``max_rows`` drawn by hash if that is asked for.

    Every label is learned; a model is 2**BITS floats for each. ``max_languages``
    says how many there may be; more raise an error. Rows with a null label or a
    null or empty text say nothing. Without any there is no language but the
    unknown one. Tasks count about TASK_BYTES of text each, however many
    partitions the rows come in.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text <> ''")
    rows = rows.withColumn("h", F.xxhash64("text"))
    size = F.lit(0) if max_rows is None else F.approx_count_distinct("h", 0.02)
    by = rows.groupBy("lang").agg(size.alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).limit(max_languages + 1).collect()
    if len(by) > max_languages:
        raise ValueError(f"more than {max_languages} labels")
    languages = tuple(sorted(r.lang for r in by))
    index = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, which in zip(batch.column(0), batch.column(1).to_pylist()):
                own = counts.setdefault(index[which], np.zeros(1 << BITS, np.int64))
                for codes in _codes(t.as_py()):
                    own += np.bincount(codes, minlength=1 << BITS)
        for k, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["k", "code", "n"])

    counts = np.zeros((len(languages), 1 << BITS))
    if languages:
        if max_rows is not None:
            part = {r.lang: 1_000_000 if r.n <= 1.1 * max_rows else int(1e6 * max_rows / r.n) + 1 for r in by}
            shares = F.create_map(*[F.lit(x) for two in part.items() for x in two])
            rows = rows.where(F.pmod("h", F.lit(1_000_000)) < shares[F.col("lang")])
        tasks = max(labelled.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(r["bytes"] for r in by) / TASK_BYTES))
        counted = small_batches(_distinct(rows).coalesce(tasks)).mapInArrow(count, "k int, code int, n bigint")
        sums = counted.groupBy("k", "code").agg(F.sum("n").alias("n")).toPandas()
        counts[sums["k"], sums["code"]] = sums["n"]  # at most 2**BITS for each language
    seen = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return Model(languages, np.log((1 - UNIFORM) * seen + UNIFORM / (1 << BITS)).T.astype(np.float32).copy())


def _read_texts(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``text`` replaced by ``ll``, its log likelihoods."""
    kept = [c for c in rows.columns if c != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ll = pa.array([own.likelihoods(t.as_py()) for t in batch.column(len(kept))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(batch.columns[: len(kept)] + [ll], [*kept, "ll"])

    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("ll", T.ArrayType(T.DoubleType()))])
    return small_batches(rows.select(*kept, "text")).mapInArrow(read, schema)


def _host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def _suffix(url: Column, host: Column) -> Column:
    """The address's top-level domain, with a first path segment that has the form of a language code."""
    path = F.lower(F.regexp_extract(url, r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    return F.nullif(F.concat_ws("/", F.regexp_extract(host, r"([^.]+)$", 1), F.nullif(path, F.lit(""))), F.lit(""))


def _counts(rows: DataFrame, key: str, to: str, width: int, small: int) -> tuple[DataFrame, bool]:
    """For each value of ``key`` the number of rows of each class, as an array ``to``; and whether it may be broadcast."""
    sums = [F.sum((F.col("says") == k).cast("double")) for k in range(width)]
    table = materialize(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*sums).alias(to)), to)
    return table, table.count() <= small


def identify(
    rows: DataFrame,
    model: Model,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    declared: str | None = None,
    host: str | None = None,
    url: str | None = None,
    min_confidence: float = 0.5,
    small: int = 200_000,
) -> DataFrame:
    """``keys, language, confidence, accepted`` for each of ``rows``.

    ``declared`` and ``url`` (or ``host``, where there is no address) name columns;
    evidence that a row lacks, being null, says nothing. ``language`` is that of
    the highest posterior (ties: the first by name, UNKNOWN last), ``confidence``
    its probability. A row is accepted if that is a language and at least
    ``min_confidence``. A null or empty text leaves the other evidence to decide.
    Repeated rows and null keys are rows like others; an empty table gives an
    empty result. Tables of hosts, domains and suffixes are broadcast up to
    ``small`` rows each and joined by shuffle beyond.
    """
    names, width = [*model.languages, UNKNOWN], len(model.languages) + 1
    none = F.lit(None).cast("string")
    at = _host(F.col(url)) if url else (F.lower(F.col(host)) if host else none)
    inner = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    base = rows.select(
        *inner,
        F.lower(F.regexp_extract(F.trim(F.col(declared)), "^([A-Za-z]+)", 1)).alias("declared") if declared else none.alias("declared"),
        at.alias("host"),
        (F.nullif(F.regexp_extract(at, r"([^.]+\.[^.]+)$", 1), F.lit("")) if url else none).alias("domain"),
        (_suffix(F.col(url), at) if url else none).alias("suffix"),
        F.col(text).alias("text"),
    )
    read = _read_texts(base, model).withColumn("says", F.array_position("ll", F.array_max("ll")).cast("int") - 1)
    known = F.array(*[F.lit(x) for x in names])
    spoken = F.when(F.col("declared").isNull() | (F.col("declared") == ""), None).when(F.array_contains(known, F.col("declared")), F.col("declared")).otherwise("other")
    read = materialize(read.withColumn("declared", spoken), "likelihoods")

    pairs = read.groupBy("declared", "says").count().collect()  # at most (languages + 3) times (languages + 1)
    whole = np.array([sum(r["count"] for r in pairs if r.says == k) for k in range(width)], float)
    total = whole.sum()
    share = (whole + 1) / (total + width)
    values = sorted({r.declared for r in pairs if r.declared is not None})
    said = {v: [math.log((sum(r["count"] for r in pairs if r.declared == v and r.says == k) + 0.5) / (sum(r["count"] for r in pairs if r.declared is not None and r.says == k) + 0.5 * (len(values) + 1))) for k in range(width)] for v in values}

    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    zeros = array([0.0] * width)
    out = read.withColumn("own", F.array(*[(F.col("says") == k).cast("double") for k in range(width)]))
    for key in ("host", "domain", "suffix"):
        if (key == "host" and at is not none) or url:
            table, fits = _counts(read, key, f"n_{key}", width, small)
            out = out.join(F.broadcast(table) if fits else table, key, "left")
        else:
            out = out.withColumn(f"n_{key}", F.lit(None).cast("array<double>"))
    minus = lambda c: F.zip_with(F.coalesce(F.col(c), F.col("own")), "own", lambda a, b: a - b)
    total_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    smoothed = lambda counts, prior: F.zip_with(counts, prior, lambda a, b: (a + KAPPA * b) / (total_of(counts) + KAPPA))
    out = out.withColumn("p", smoothed(minus("n_domain"), array(share))).withColumn("p", smoothed(minus("n_host"), F.col("p")))
    # P(suffix | language), drawn towards the suffix's general share
    overall = total_of(F.col("n_suffix")) / F.lit(max(total, 1.0))
    suffix = F.zip_with(minus("n_suffix"), array(whole), lambda a, b: F.log((a + KAPPA * overall) / (b + KAPPA)))
    out = out.withColumn("s", F.when(F.col("n_suffix").isNull(), zeros).otherwise(suffix))
    mark = F.create_map(*[x for v in values for x in (F.lit(v), array(said[v]))]) if values else None
    out = out.withColumn("d", F.coalesce(mark[F.col("declared")], zeros) if mark is not None else zeros)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    out = out.withColumn("score", add(add(F.col("ll"), F.col("d")), add(F.col("s"), F.transform("p", lambda x: F.ln(x)))))
    best = F.array_max("score")
    odds = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    place = F.array_position("score", best).cast("int")
    out = out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.element_at(known, place).alias("language"), (1.0 / odds).alias("confidence"))
    return out.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("confidence") >= min_confidence))


def declared_language(html: Column) -> Column:
    """The ``lang`` of a page's ``html`` element, null if it has none."""
    return F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))


