"""Approximate nearest neighbours by inner product: stable projections in a kd-tree.

Vectors get one more component that makes all norms equal, so that the largest
inner product is the smallest Euclidean distance. A Gaussian matrix, which is
2-stable, projects them to a few dimensions: the squared projected distance over
the squared distance follows a chi-square law. The projections are dealt out to
the leaves of a kd-tree. A query goes through leaves, and in each through points,
from the nearest projection on, verifies them by the true measure, and stops where
a point as near as its k-th best would with probability ``confidence`` have been
projected nearer than all that is left (the chi-square test).

The walk is a series of rounds of Spark joins: in each, every query that is not
stopped visits its next leaves, twice, four times ... as many as before. Equal
vectors are searched, and found, once, as a class with its smallest ids; large
leaves and many queries at one leaf are cut into blocks. The driver holds the
tree only: at most MAX_LEAVES boxes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.skew import uneven_join
from wayline.storage import discard, materialize

DIMS = 16
CONFIDENCE = 0.87
LEAF, MAX_LEAVES, SAMPLE = 4096, 1 << 14, 100_000
FIRST = 2
_BLOCK = 8192


def chi_square_inverse(p: float, m: int) -> float:
    """The p-quantile of the chi-square law with m (even) degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))
        low, high = (x, high) if below < p else (low, x)
    return low


class Tree:
    """A kd-tree over a sample of projections; boxes of the leaves are set from all points later."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.cuts: list[tuple[int, float]] = []  # of inner nodes in level order
        self.depth = max(0, (leaves - 1).bit_length())
        groups = [points]
        for _ in range(self.depth):
            halves = []
            for g in groups:
                axis = int(np.ptp(g, axis=0).argmax()) if len(g) else 0
                cut = float(np.median(g[:, axis])) if len(g) else 0.0
                self.cuts.append((axis, cut))
                right = g[:, axis] > cut
                halves += [g[~right], g[right]]
            groups = halves
        self.low = self.high = np.empty((0, points.shape[1]))
        self.ids = np.empty(0, np.int64)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        if not self.cuts:
            return node
        axes, cuts = np.array([a for a, _ in self.cuts]), np.array([c for _, c in self.cuts])
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, axes[node]] > cuts[node])
        return node - (len(self.cuts))

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.ids)))
        for k in range(queries.shape[1]):
            q = queries[:, k : k + 1]
            out += np.maximum(np.maximum(self.low[None, :, k] - q, q - self.high[None, :, k]), 0) ** 2
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32) if len(rows) else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Distinct ``id, vec`` of rows that take part: no null, zero or non-finite vectors, all of the most frequent length."""
    v = F.col(vector)
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    return rows.distinct()


def _kernel(width: int, k: int, bound: float):
    """Joins the points of a leaf's block with the queries that visit it: the best k for each query."""

    def search(queries: pa.Table, points: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "scores": pa.array([], pa.list_(pa.float64())), "found": pa.array([], pa.list_(pa.int64())), "verified": pa.array([], pa.int64())})
        if not queries.num_rows or not points.num_rows:
            return empty
        ids = points["cid"].to_numpy()
        order = np.argsort(ids)  # so that ties fall to the smaller id
        ids, vecs, proj = ids[order], _matrix(points["vec"], width)[order], _matrix(points["proj"], DIMS)[order]
        norms = (proj**2).sum(1)
        slack = 1e-9 * max(1.0, float(np.abs(vecs).max()) ** 2 * width)
        qvec, qproj, d2 = _matrix(queries["vec"], width), _matrix(queries["proj"], DIMS), queries["d2"].to_numpy()
        qid, scores, found, verified = queries["qid"].to_numpy(), [], [], []
        for a in range(0, len(qid), 256):
            q, p = qvec[a : a + 256], qproj[a : a + 256]
            apart = (p**2).sum(1)[:, None] - 2 * p @ proj.T + norms[None, :]
            near = apart < bound * d2[a : a + 256, None] + 1e-9  # the stopping test, point by point
            dense = near.mean() > 0.2
            all_scores = q @ vecs.T if dense else None
            for i in range(len(q)):
                at = np.flatnonzero(near[i])
                if len(at) > k:
                    rough = all_scores[i, at] if dense else vecs[at] @ q[i]
                    floor = np.partition(rough, len(rough) - k)[len(rough) - k]
                    at = at[rough >= floor - slack]
                # one order of summing, whatever the batch, so that equal products stay equal
                s = (vecs[at] * q[i]).sum(axis=1)
                best = np.argsort(-s, kind="stable")[:k]
                verified.append(int(near[i].sum()))
                scores.append(s[best])
                found.append(ids[at[best]])
        return pa.table({"qid": pa.array(qid), "scores": pa.array(scores, pa.list_(pa.float64())), "found": pa.array(found, pa.list_(pa.int64())), "verified": pa.array(verified, pa.int64())})

    return search


def nearest(
    df: DataFrame,
    every: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vector: str = "embedding",
    confidence: float = CONFIDENCE,
    leaf: int = LEAF,
    seed: int = 7,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every`` its ``k`` nearest found among all other ids.

    Nearness is the largest inner product, in double precision; ties go to the
    smaller id. Vectors that are null, zero or hold a null or non-finite component
    take no part, nor do null ids and vectors of another length than most (ties:
    the longest). A row that repeats counts once; an id with several vectors is a
    candidate, or a query, with each. The tree's cuts come from at most about
    SAMPLE points; every point is in the index. Fewer candidates than ``k`` are
    all returned; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = materialize(usable(df, id_col, vector), "vectors")
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = sizes[0].n if sizes else 1
    rows = rows.where(F.size("vec") == width)

    # classes of equal vectors, with their k + 1 smallest ids
    same = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("rank", F.row_number().over(same)).where(F.col("rank") <= k + 1)
    classes = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    members = Window.partitionBy(F.element_at("ids", 1)).orderBy("vec")
    # a class is named by its smallest id; should several vectors share that id, by a number after it
    classes = classes.withColumn("nth", F.row_number().over(members)).select(F.element_at("ids", 1).alias("first"), "nth", "vec", "ids")
    classes = materialize(classes, "classes")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, top, clash = classes.agg(F.count("*"), F.max(norm), F.max("nth")).first()
    if clash and clash > 1:  # then by place in a sorted table, which keeps the order of smallest ids too
        classes = materialize(classes.orderBy("first", "nth").withColumn("cid", F.monotonically_increasing_id()), "classes")
    else:
        classes = classes.withColumn("cid", F.col("first"))
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    project = np.random.default_rng(seed).standard_normal((width + 1, DIMS))

    def augmented(vecs: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(vecs)) if query else np.sqrt(np.maximum(top - (vecs**2).sum(1), 0))
        return np.hstack([vecs, last[:, None]]) @ project

    share = min(1.0, SAMPLE / n)
    drawn = classes.where(F.pmod(F.xxhash64("first"), F.lit(1_000_000)) < int(share * 1e6) + 1).select("vec").limit(2 * SAMPLE).toArrow()
    leaves = max(1, min(MAX_LEAVES, 1 << max(0, math.ceil(math.log2(max(1, n / leaf))))))
    tree = Tree(augmented(_matrix(drawn["vec"], width)), leaves)
    planted = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            proj = augmented(_matrix(b.column(1), width))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(proj), pa.array(planted.value.leaf(proj))], ["cid", "vec", "proj", "leaf"])

    points = materialize(classes.select("cid", "vec").mapInArrow(index, "cid bigint, vec array<double>, proj array<double>, leaf bigint"), "points")
    sides = [f(F.element_at("proj", j + 1)) for j in range(DIMS) for f in (F.min, F.max)]
    boxes = points.groupBy("leaf").agg(F.count("*").alias("n"), F.array(*sides).alias("sides")).orderBy("leaf").collect()  # MAX_LEAVES at most
    tree.ids = np.array([b.leaf for b in boxes])
    tree.low, tree.high = (np.array([b.sides[j::2] for b in boxes]) for j in (0, 1))
    walk = spark.sparkContext.broadcast(tree)
    blocks = {b.leaf: -(-b.n // leaf) for b in boxes}
    parts = spark.sparkContext.broadcast(blocks)
    bound = chi_square_inverse(confidence, DIMS)

    # queries: one for each class that holds one
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "vec")
    wanted = asked.groupBy("vec").agg(F.count("*").alias("owners")).join(classes, "vec").select(F.col("cid").alias("qid"), "vec", "owners")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(augmented(_matrix(b.column(1), width), True)), b.column(2)], ["qid", "vec", "proj", "owners"])

    queries = materialize(wanted.mapInArrow(start, "qid bigint, vec array<double>, proj array<double>, owners bigint"), "queries")
    state = queries.select("qid", "vec", "proj", F.lit(None).cast("array<struct<s:double,id:bigint>>").alias("best"))

    def route(first: int, last: int):
        """Each query's leaves from place ``first`` to ``last`` by distance, as far as the stopping test lets it go."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vec, proj, kth = _matrix(b.column(1), width), _matrix(b.column(2), DIMS), b.column(3).to_numpy(zero_copy_only=False)
                # |x - q|^2 of the k-th best so far, in the space with equal norms
                d2 = np.where(np.isnan(kth), np.inf, np.maximum(top + (vec**2).sum(1) - 2 * kth, 0))
                for a in range(0, len(vec), 256):
                    apart = walk.value.distances(proj[a : a + 256])
                    order = np.argsort(apart, axis=1, kind="stable")[:, first:last]
                    open_ = np.take_along_axis(apart, order, 1) < bound * d2[a : a + 256, None] + 1e-9
                    at, place = np.nonzero(open_)
                    goal = walk.value.ids[order[at, place]]
                    times = np.array([parts.value[x] for x in goal.tolist()], np.int64)
                    pick = pa.array(np.repeat(at + a, times))
                    block = np.concatenate([np.arange(t) for t in times.tolist()]) if len(times) else np.empty(0, np.int64)
                    columns = [b.column(k).take(pick) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(d2[at + a], times)), pa.array(np.repeat(goal, times)), pa.array(block)], ["qid", "vec", "proj", "d2", "leaf", "block"])

        return rows

    place, size = 0, FIRST
    many = spark.createDataFrame([(int(x), int(t)) for x, t in blocks.items()], "leaf bigint, blocks bigint")
    cut = points.join(F.broadcast(many), "leaf").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    cut = cut.select("cid", "vec", "proj", "leaf", "block")
    while place < len(boxes):
        kth = F.try_element_at("best", F.lit(k + 1))["s"]
        routed = state.select("qid", "vec", "proj", kth.alias("kth")).mapInArrow(route(place, place + size), "qid bigint, vec array<double>, proj array<double>, d2 double, leaf bigint, block bigint")
        routed = materialize(routed, "visits")
        # queries at a leaf go to all its blocks; those of a busy leaf are cut into groups, and its points copied for each
        busy = routed.where("block = 0").groupBy("leaf").agg(F.ceil(F.count("*") / _BLOCK).alias("groups"))
        busy = F.broadcast(materialize(busy, "busy"))  # MAX_LEAVES rows at most
        if busy.isEmpty():
            break  # every query has stopped
        here = routed.join(busy, "leaf").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("groups")))
        here = here.select("qid", "vec", "proj", "d2", "leaf", "block", "part")
        there = cut.join(busy, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
        there = there.select("cid", "vec", "proj", "leaf", "block", "part")
        key = ["leaf", "block", "part"]
        found = here.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(
            _kernel(width, k + 1, bound), "qid bigint, scores array<double>, found array<bigint>, verified bigint"
        )
        best = F.transform(F.arrays_zip("scores", "found"), lambda x: F.struct((-x["scores"]).alias("s"), x["found"].alias("id")))
        merged = found.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list(best))), 1, k + 1).alias("more"))
        more = F.transform("more", lambda x: F.struct((-x["s"]).alias("s"), x["id"].alias("id")))
        both = F.concat(F.coalesce(F.col("best"), F.array().cast("array<struct<s:double,id:bigint>>")), F.coalesce(more, F.array().cast("array<struct<s:double,id:bigint>>")))
        ranked = F.slice(F.array_sort(F.transform(both, lambda x: F.struct((-x["s"]).alias("s"), x["id"].alias("id")))), 1, k + 1)
        turned = F.transform(ranked, lambda x: F.struct((-x["s"]).alias("s"), x["id"].alias("id")))
        after = materialize(state.join(merged, "qid", "left").select("qid", "vec", "proj", turned.alias("best")), "queries")
        discard(routed)
        if place:
            discard(state)
        state = after
        place, size = place + size, max(size * 4, FIRST)

    # from classes back to ids: all that a class was found with, best first
    named = classes.select(F.col("cid").alias("id"), "ids")
    hits = state.select("qid", F.explode("best").alias("b")).select("qid", "b.s", "b.id").join(named, "id")
    hits = hits.select("qid", F.explode("ids").alias("vec_id"), "s").groupBy("qid")
    hits = hits.agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "vec_id"))).alias("hits"))
    known = queries.select("qid", "vec", "owners").join(hits, "qid")
    known = materialize(known, "hits")
    mine = asked.select(F.col("id").alias("query_id"), "vec")
    found = uneven_join(mine, known.select("vec", "hits", "owners"), ["vec"], "owners", asked.count())
    others = F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = found.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
