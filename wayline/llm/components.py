"""Connected components of a link table by alternating stars.

Every round is a partial aggregation and an equi-join, so a node with very many
links costs no more than its rows, and neither links nor labels leave the executors.
The rows of such a node are joined with one row of labels; Spark's adaptive skew
join, which the session must not turn off, splits them over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours (edges point downwards) on the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v")))


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of a few links in one task."""
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while to.setdefault(x, x) != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    for part in batches:
        for u, v in zip(part["u"].tolist(), part["v"].tolist()):
            p, q = root(u), root(v)
            to[max(p, q)] = min(p, q)
    if to:
        yield pd.DataFrame({"node": list(to), "root": [root(x) for x in list(to)]})


def connected_components(links: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """``node, root`` for every node that has a link; the root is the least node of the component.

    Up to ``few`` links, whose ends are whole numbers, are followed in one task,
    more of them in rounds of joins.

    Self links, repeated links and links with a null end are ignored; an empty
    table gives an empty result. The number of rounds grows with the logarithm
    of the longest path.
    """
    edges = materialize(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    if few and edges.count() <= few:
        return edges.coalesce(1).mapInPandas(_within, "node bigint, root bigint")
    seen = None
    while True:
        nxt = materialize(_small_star(_large_star(edges).distinct()).distinct(), "links")
        discard(edges)
        edges = nxt
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(now)
