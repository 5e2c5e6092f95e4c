"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches from the largest ids down. A run holds line
hashes, each with the document that keeps the line and the number of documents
and lines of its batch that hold it; it is bucketed by hash and sorted within
buckets. A batch's hashes are shuffled once and merge-joined with the runs as
they lie: those that no run has are first sightings, kept by the largest document
of the batch, and become a run of their own; the rest are repeats and only add to
counts. When a level has ``fanout`` runs, an outer merge join compacts them into
one of the next level. So every hash is in one run at most, and each is rewritten
once a level.

Lines that make up a good part of all are joined by a broadcast of their hashes,
of which there can't be many, the others by shuffle: no task gets all lines of one
kind.

DataFrame operations only; a line's hash has 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.skew import uneven_join
from wayline.storage import bucketed, discard, materialize, sorted_scans

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]
#: Stands for a null id, below all others.
_NO_ID = -(2**63)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, all else untouched; ``lower`` does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _row_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


class LineRuns:
    """The runs of one corpus: batches come from the largest document ids down."""

    def __init__(self, fanout: int = 2) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []
        self.tables: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        self.tables.append(bucketed(rows, name, _HASH))
        return self.tables[-1]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``h1, h2, doc``, rows of which may repeat."""
        new = lines.groupBy(*_HASH, "doc").agg(F.count("*").alias("n")).groupBy(*_HASH)
        new = new.agg(F.max("doc").alias("keeper"), F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"))
        seen = F.lit(False)
        for k, run in enumerate(self.runs()):
            new = new.join(run.select(*_HASH, F.lit(True).alias(f"in{k}")), _HASH, "left")
            seen = seen | F.col(f"in{k}").isNotNull()
        batch = self._write(new.select(*_HASH, "keeper", "n_docs", "n_lines", seen.alias("seen")), "batch")
        if self.runs():
            self.repeats.append(batch.where("seen").select(*_HASH, "n_docs", "n_lines"))
        self._put(0, batch.where("not seen").drop("seen"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = full[0]
            for other in full[1:]:  # no hash is in both
                mine, theirs = merged.alias("a"), other.alias("b")
                both = mine.join(theirs, [F.col(f"a.{h}") == F.col(f"b.{h}") for h in _HASH], "full")
                merged = both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in other.columns])
            self._put(level + 1, self._write(merged, f"run{level + 1}"))

    def repeated(self, at_least: int) -> DataFrame:
        """``h1, h2, keeper, n_lines`` of hashes that ``at_least`` documents hold."""
        out = None
        for run in self.runs():
            docs, lines = F.col("n_docs"), F.col("n_lines")
            for k, more in enumerate(self.repeats):
                run = run.join(more.select(*_HASH, F.col("n_docs").alias(f"d{k}"), F.col("n_lines").alias(f"l{k}")), _HASH, "left")
                docs, lines = docs + F.coalesce(f"d{k}", F.lit(0)), lines + F.coalesce(f"l{k}", F.lit(0))
            some = run.where(docs >= at_least).select(*_HASH, "keeper", lines.alias("n_lines"))
            out = some if out is None else out.unionByName(some)
        with sorted_scans(out.sparkSession):
            return materialize(out, "repeated")

    def discard(self) -> None:
        for table in self.tables:
            discard(table)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` (columns of these names are replaced).

    A text is split at line feeds; a null or empty one is one empty line. A line's
    key is the line without blanks at its ends, A-Z in lower case. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold lose all
    their lines but those of the largest id that holds it; what is left is joined
    by line feeds, an empty text if nothing is. Rows of one id count as one
    document and rows that repeat are treated alike. A null id counts as one
    document below all others. ``batches`` and ``fanout`` change the work done,
    not the result. An empty table gives an empty result.
    """
    added = ("kept_text", "n_lines", "n_dropped")
    docs = docs.drop(*added)
    body = F.coalesce(F.col(text), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    key = F.expr(f"trim(BOTH '{BLANKS}' FROM line)")
    lines = (
        docs.select(doc.alias("doc"), *_row_key(body), F.posexplode(F.split(ascii_lower(body), "\n", -1)).alias("pos", "line"))
        .withColumn("line", key)
        .where(F.char_length("line") >= min_chars)
        .select("doc", "t1", "t2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))
    )
    lines = materialize(lines, "lines")
    parts = [k / batches for k in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("doc", parts, 1000)).first()[0] if parts else []
    edges = sorted(set(cuts or []), reverse=True)
    runs = LineRuns(fanout)
    for k in range(len(edges) + 1):
        some = lines if k == 0 else lines.where(F.col("doc") <= edges[k - 1])
        runs.add((some.where(F.col("doc") > edges[k]) if k < len(edges) else some).select(*_HASH, "doc"))
    repeated = runs.repeated(min_docs)
    runs.discard()
    found = uneven_join(lines, repeated, _HASH, "n_lines", lines.count()).where("doc < keeper")
    drops = found.groupBy("doc", "t1", "t2").agg(F.collect_set("pos").alias("__drop"))
    keyed = docs.select("*", doc.alias("__doc"), *[c.alias(f"__{n}") for c, n in zip(_row_key(body), ("t1", "t2"))])
    drops = drops.select(*[F.col(c).alias(f"__{c}") for c in ("doc", "t1", "t2")], "__drop")
    split = F.split(body, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(1), F.size("__lines")), F.transform("__drop", lambda p: p + 1))
    joined = keyed.join(drops, ["__doc", "__t1", "__t2"], "left").withColumn("__lines", split)
    return joined.select(
        *docs.columns,
        F.when(F.col("__drop").isNull(), body)
        .otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("__lines", i)), "\n"))
        .alias("kept_text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
