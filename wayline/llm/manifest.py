"""A Merkle manifest of a table: one tree for each source, one over the sources.

Rows are numbered within their source, every FANOUT consecutive nodes are hashed
into a parent, level by level, until one is left, the source's subroot; subroots,
numbered by source, make a tree of the same kind, whose last node is the root.
A row's proof holds the siblings of its path from below to the root.

The numbers come from ranges: rows are dealt out by source and order, a window
numbers each range of a source by itself, and the counts of the ranges before it
are added, so a source with most of the rows is numbered by many tasks. A parent
is a group of at most FANOUT rows. Proofs are handed down from the root, each
level to the next, so all these joins together move about half a row's proof a
row, and each level is a written table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.storage import discard, materialize

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def row_digest(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as its count of bytes, a colon and itself, ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def number(rows: DataFrame, order: Sequence[str], group: str = "grp") -> DataFrame:
    """``rows`` with ``idx``, their number from 0 within ``group`` by ``order``, and ``n``, how many the group has."""
    ranged = rows.repartitionByRange(group, *order).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    so_far = Window.partitionBy(group).orderBy("__range")
    counts = ranged.groupBy(group, "__range").agg(F.count("*").alias("__here"))
    counts = counts.select(
        group, "__range", (F.sum("__here").over(so_far) - F.col("__here")).alias("__before"), F.sum("__here").over(Window.partitionBy(group)).alias("n")
    )
    here = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order)) - 1
    numbered = materialize(ranged.join(counts, [group, "__range"]).withColumn("idx", here + F.col("__before")).drop("__range", "__before"), "numbered")
    discard(ranged)
    return numbered


@dataclass
class Forest:
    """The trees of all groups: ``levels[k]`` has the nodes ``k + 1`` levels above the leaves, with their children."""

    levels: list[DataFrame] = field(default_factory=list)
    #: ``grp, level, digest``: where each group's tree ends.
    tops: DataFrame | None = None


def build(leaves: DataFrame, fanout: int = FANOUT) -> Forest:
    """The trees over ``leaves`` (``grp, idx, n, digest``)."""
    forest, below = Forest(), leaves
    ends = [leaves.where("n = 1").select("grp", F.lit(0).alias("level"), "digest")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        parents = below.where("n > 1").groupBy("grp", F.floor(F.col("idx") / fanout).alias("idx"))
        parents = parents.agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("children"))
        parents = parents.select(
            "grp", "idx", F.ceil(F.col("n") / fanout).alias("n"), digest(F.array_join("children.digest", "")).alias("digest"), "children.digest"
        ).toDF("grp", "idx", "n", "digest", "children")
        below = materialize(parents, "nodes")
        forest.levels.append(below)
        ends.append(below.where("n = 1").select("grp", F.lit(len(forest.levels)).alias("level"), "digest"))
        most = -(-most // fanout)
    tops = ends[0]
    for more in ends[1:]:
        tops = tops.unionByName(more)
    forest.tops = materialize(tops, "tops")
    return forest


STEP = "struct<before:string,after:string>"


def _step(children: Column, at: Column) -> Column:
    """What a node's siblings put before and after it; ``at`` is its place among its parent's children."""
    at = at.cast("int")
    return F.struct(
        F.array_join(F.slice(children, F.lit(1), at), "").alias("before"),
        F.array_join(F.slice(children, at + 2, F.size(children)), "").alias("after"),
    )


def prove(leaves: DataFrame, forest: Forest, above: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` with ``top``, the digest that their tree ends in, and ``proof``: the steps from below to there.

    ``above`` (``grp, proof``) has steps that follow for the whole group.
    """
    tops = forest.tops.withColumn("proof", F.expr(f"cast(array() as array<{STEP}>)")) if above is None else forest.tops.join(above, "grp")
    tops = materialize(tops.select("grp", "level", F.lit(0).cast("long").alias("idx"), F.col("digest").alias("top"), "proof"), "proofs")
    known, met = None, None
    for k in range(len(forest.levels), 0, -1):
        here = tops.where(F.col("level") == k).drop("level")
        met = forest.levels[k - 1].select("grp", "idx", "children").join(here if known is None else known.unionByName(here), ["grp", "idx"])
        if k > 1:
            child = met.select("*", F.posexplode("children").alias("at", "__digest"))
            steps = F.concat(F.array(_step(F.col("children"), F.col("at"))), F.col("proof"))
            below = materialize(child.select("grp", (F.col("idx") * fanout + F.col("at")).alias("idx"), "top", steps.alias("proof")), "proofs")
            if known is not None:
                discard(known)
            known = below
    alone = leaves.where("n = 1").join(tops.where("level = 0").select("grp", "top", "proof"), "grp")
    alone = alone.select(*leaves.columns, "top", "proof")
    if met is None:
        return alone
    parents = met.withColumnsRenamed({"idx": "__parent", "proof": "__proof"})
    rest = leaves.where("n > 1").withColumn("__parent", F.floor(F.col("idx") / fanout)).join(parents, ["grp", "__parent"])
    steps = F.concat(F.array(_step(F.col("children"), F.col("idx") % fanout)), F.col("__proof"))
    return rest.select(*leaves.columns, "top", steps.alias("proof")).unionByName(alone)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    return F.aggregate(proof, leaf, lambda seen, step: digest(step["before"], seen, step["after"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, from below to the root, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, source: str = "source", order: str = "doc_id", keep: Sequence[Column] = (), fanout: int = FANOUT
) -> DataFrame:
    """``order``'s column, ``keep``'s, ``leaf, subroot, root, proof`` for each row of ``docs``.

    A leaf is the digest of ``fields``; a source's leaves ascend by ``order``, nulls
    first, then by leaf, so rows that repeat stand side by side, each a leaf of its
    own. A null source is a source, and the first. Null and empty texts have
    different digests. ``proof`` is an array of steps from below to the root, each
    with the hex digests before and after the node; it is empty where a lone row is
    the whole table. An empty table gives an empty result. Columns that are neither
    in ``fields`` nor in ``keep`` are ignored.
    """
    # null first, then bytewise: the prefix changes neither
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = docs.select(
        F.col(order).alias("__order"), F.struct(F.lit(0).alias("__"), *keep).alias("__keep"), name.alias("grp"),
        row_digest([F.col(c) for c in fields]).alias("digest"), F.monotonically_increasing_id().alias("__row"),
    )
    rows = materialize(rows, "leaves")
    leaves = number(rows, ["__order", "digest", "__row"])
    discard(rows)
    forest = build(leaves, fanout)
    sources = number(forest.tops.select(F.lit(0).alias("one"), F.col("grp").alias("source"), "digest"), ["source"], "one")
    sources = sources.withColumnRenamed("one", "grp")
    above = prove(sources, build(sources, fanout), fanout=fanout).select(F.col("source").alias("grp"), F.col("top").alias("root"), "proof")
    above = materialize(above, "above")
    root = above.select("root").first()  # the same in all rows; none where there are no rows
    proved = prove(leaves, forest, above.select("grp", "proof"), fanout)
    return proved.select(
        F.col("__order").alias(order), *[f"__keep.{c}" for c in proved.select("__keep.*").columns if c != "__"],
        F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root and root[0]).cast("string").alias("root"), "proof",
    )
