"""Near-duplicates by the Jaccard similarity of word shingles, found with SetSketch registers.

A text's set holds its distinct shingles of SHINGLE words. Each of its M
registers keeps the least of its shingles' exponential variates on a grid of
powers of BASE, cut to a byte: registers of a union are the larger ones of the
two, and two sets agree in a register with a probability of little more than their
similarity. BANDS bands of registers make the candidates: at the similarity asked
for (0.8) a pair shares no band with a probability of 2e-9.

Sets that are equal are one class. First each class of a band's bucket is compared
with the bucket's hub, the class that meets most others. That connects nearly all
that is alike; a hub most of whose classes have one better hub gives its buckets to that
one first, and the buckets of one hub are one group from then on, in which each class
is one row, however many buckets it shares. Where a
group's classes are not all connected, those outside its largest component are
compared with all others that they share a bucket and are not connected with: first each is confirmed
with its most similar partner, then those that had more are with all of them. So no
pair of a bucket that could connect anything stays unseen, and copies of copies
don't meet in pairs.
For a candidate the likelihood of the counts of larger, smaller and equal registers
gives the similarity; what it puts below PROBABLY is dropped (at 0.8 that is five standard
deviations away), the others are confirmed on their full sets. The last comparison,
of what is nearly alike in great numbers, has FINE registers for a sharper look, and a bound
that misses nothing: which of the hub's shingles both hold, and how many others each shares
with any class of the group.

Both comparisons are made in blocks (:func:`_blocks`): some of a group's rows on one
side are held while those of the other side stream past, and only what is alike
comes out. A large group has many blocks, each for any task.

Shingles are compared by 64-bit hashes made of their words' 64-bit hashes, classes
by 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.components import connected_components
from wayline.llm.filters import may_hold
from wayline.llm.skew import uneven_join
from wayline.storage import discard, materialize

SHINGLE = 4
#: Links have at least this similarity, in hundredths.
PERCENT = 80
BANDS, WIDTH = 48, 5
M = BANDS * WIDTH
#: The grid's base and the rate of the variates: a byte holds sets of up to some million shingles; beyond, more registers just agree.
BASE, RATE = 1.1, 20.0
#: Registers of a class that is still apart at last.
FINE = 768
#: Candidates whose most likely similarity is lower are dropped, by the number of registers.
PROBABLY = {M: 0.67, FINE: 0.727}
#: Rows of a block that are held, about, and rows that stream past them: sketches (4 MB) and sets.
SKETCHES, SETS = (4000, 4000), (64, 1000)
#: Columns of a pair that may be linked.
PAIRS = ("a", "b", "root", "g", "more")
#: Links that one task follows.
FEW = 15_000
#: Shingles of passing rows times held rows that are looked at together.
MEETINGS = 1 << 22

_rng = np.random.Generator(np.random.PCG64(12))
_FACTORS = {m: _rng.integers(0, 1 << 63, m, np.uint64) * np.uint64(2) + np.uint64(1) for m in (M, FINE)}
_PLACES = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Hashes of words; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text's whole sequence is one, no words give none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed += h[k : k + n] * _PLACES[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def registers(hashes: np.ndarray, m: int = M) -> np.ndarray:
    """The ``m`` registers of a set, a byte each."""
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(least, (_FACTORS[m][:, None] * hashes[None, k : k + 512]).min(axis=1), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 + 2.0**-53) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / np.log(BASE)), 0, 255).astype(np.uint8)


def _slope(j: np.ndarray | float, a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The slope at similarity ``j`` of the log likelihood of the registers ``a`` and ``b``; ``u``: the first set's share of both sizes."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    v, cut, log = 1 - u, (BASE - 1) / BASE, np.log(BASE)
    x, y = np.maximum(u - v * j, 0), np.maximum(v - u * j, 0)
    p, q = np.maximum(-np.log1p(-x * cut) / log, 1e-12), np.maximum(-np.log1p(-y * cut) / log, 1e-12)
    dp, dq = -v * cut / (1 - x * cut) / log, -u * cut / (1 - y * cut) / log
    return larger * dp / p + smaller * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-12)


def likeliest(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity that makes the registers' comparisons most likely; one row of ``a`` and ``b`` a pair."""
    u = n_a / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(30):  # the likelihood is concave: halve to where its slope changes sign
        j = (low + high) / 2
        rising = _slope(j, a, b, u) > 0
        low, high = np.where(rising, j, low), np.where(rising, high, j)
    return (low + high) / 2


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ids, sketches = [], [], []
        for text in batch.column(batch.num_columns - 1):
            hashes = shingle_set(text.as_py())
            n.append(len(hashes))
            ids.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            sketches.append(registers(hashes).tobytes() if len(hashes) else None)
        more = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names[:-1], "n", "k", "sketch"])


def _made(batches: Iterator[pa.RecordBatch], of: Callable[[np.ndarray], object], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """``c`` and what ``of`` makes of the set of each text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            values = [of(shingle_set(text.as_py())) for text in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, kind)], ["c", "made"])


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``g, c``, a bit for each of the hub's shingles that the class has, and its ``others``."""
    for batch in batches:
        bits, others = [], []
        for own, hub in zip(batch.column(2), batch.column(3)):
            own, hub = (x.values.to_numpy(zero_copy_only=False) for x in (own, hub))
            bits.append(np.packbits(np.isin(hub, own)).tobytes())
            others.append(np.setdiff1d(own, hub, assume_unique=True))
        more = [pa.array(bits, pa.binary()), pa.array(others, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], ["g", "c", "bits", "others"])


def _outlined(rows: DataFrame, sets: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """``g, c, bits, shared`` of rows ``g, c``: which of the hub's shingles a class has, and how many others that some class of the group has too.

    Two classes of a group have no more shingles in common than the bits that are set in both and
    the lesser of what they share otherwise. ``sizes`` has the ``size`` of each group of the ``total`` rows.
    """
    hubs = sizes.join(sets.withColumnRenamed("c", "g").withColumnRenamed("members", "hub"), "g")
    met = uneven_join(rows.select("g", "c").join(sets, "c"), hubs, ["g"], "size", total).select("g", "c", "members", "hub")
    met = materialize(met.mapInArrow(_against, "g bigint, c bigint, bits binary, others array<bigint>"), "outlines")
    alone = met.select("g", "c", F.explode("others").alias("h")).groupBy("g", "h").agg(F.count("*").alias("many"), F.min("c").alias("c")).where("many = 1")
    alone = alone.groupBy("g", "c").agg(F.count("*").alias("alone"))
    shared = F.size("others") - F.coalesce("alone", F.lit(0))
    return materialize(met.join(alone, ["g", "c"], "left").select("g", "c", "bits", shared.alias("shared")), "outlined")


def _text_key() -> list:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def _blocks(held: DataFrame, passing: DataFrame, payload: str, kernel: Callable, schema: str, most: tuple[int, int]) -> DataFrame:
    """What ``kernel`` makes of the rows of ``held`` and ``passing`` (``g, c, root, payload``) that have the same group ``g``.

    Held rows are dealt to blocks of about ``most[0]`` rows by their hash, passing
    ones to parts of about ``most[1]``; each block meets each part once, in one task.
    ``kernel`` gets the group, the held rows and some passing ones, as lists of
    arrays ``c, root, payload``, and returns columns of ``schema``.
    """
    size = lambda df, many, to: df.groupBy("g").agg(F.ceil(F.count("*") / many).alias(to))
    sizes = size(held, most[0], "__blocks").join(size(passing, most[1], "__parts"), "g")
    sizes = materialize(sizes, "sizes")
    count = F.sequence(F.lit(1).cast("long"), F.col("__parts")), F.sequence(F.lit(1).cast("long"), F.col("__blocks"))
    own = lambda many: 1 + F.pmod(F.xxhash64("c"), F.col(many))
    columns = ["c", "root", payload]
    at = lambda df, side, block, part: df.join(sizes, "g").select("g", block.alias("block"), part.alias("part"), F.lit(side).alias("side"), *columns)
    few = at(held, 0, own("__blocks"), F.explode(count[0]))
    many = at(passing, 1, F.explode(count[1]), own("__parts"))
    names = ["g", "block", "part"]
    rows = few.unionByName(many).repartition(*names).sortWithinPartitions(*names, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, here, out = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(i, j - i)
                if tuple(keys[i, :3]) != key:
                    key, here = tuple(keys[i, :3]), []
                if not keys[i, 3]:
                    here.append(part)
                elif here:
                    sides = [[pa.concat_arrays([x.column(k) for x in xs]) for k in (4, 5, 6)] for xs in (here, [part])]
                    out = kernel(key[0], *sides)
                    if out is not None and out.num_rows:
                        yield out

    return rows.mapInArrow(run, schema)


def _band_keys(sketches: np.ndarray) -> np.ndarray:
    """A number for the registers of each band."""
    wide = np.zeros((len(sketches), BANDS, 8), np.uint8)
    wide[:, :, :WIDTH] = sketches.reshape(-1, BANDS, WIDTH)
    return wide.view(np.uint64)[:, :, 0]


def _outlines(payload: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ``bits``, a row each, and ``shared``; rows of a group have as many bits as its hub has shingles."""
    bits = np.frombuffer(b"".join(payload.field("bits").to_pylist()), np.uint8).reshape(len(payload), -1)
    return bits, payload.field("shared").to_numpy(zero_copy_only=False)


def _alike(group: int, held: list[pa.Array], passing: list[pa.Array], banded: bool, best: bool) -> pa.RecordBatch:
    """``a, b, root, g, more`` of the pairs of different components whose sizes and registers allow the similarity; ``root`` is the passing one's.

    ``banded``: the group is the buckets of a hub; ``bands`` has a bit for the band of each that a
    row is in, and only rows that share a bucket are a pair. One that shares several is seen in the
    group of the first; if one was the hub there, both met before. Of two held ones the smaller is
    ``a``. ``best``: of each held one's pairs only that with the most equal registers, and in
    ``more`` how many others there are.
    """
    c, roots, n, bands, sketches, fine = [], [], [], [], [], []
    for ids, root, payload in (held, passing):
        c.append(ids.to_numpy(zero_copy_only=False))
        roots.append(root.to_numpy(zero_copy_only=False))
        n.append(payload.field("n").to_numpy(zero_copy_only=False).astype(np.float64))
        bands += [payload.field("bands").to_numpy(zero_copy_only=False)] if banded else []
        for to, what in ((sketches, "sketch"), (fine, "fine")):
            if what in payload.type.names:
                to.append(np.frombuffer(b"".join(payload.field(what).to_pylist()), np.uint8).reshape(len(ids), -1))
    outlines = [_outlines(side[2]) for side in (held, passing)] if "bits" in held[2].type.names else []
    looks, keys = fine or sketches, [_band_keys(x) for x in sketches] if banded else []
    found: list[list[np.ndarray]] = [[] for _ in PAIRS]
    for i in range(len(c[0])):
        sizes = 100 * np.minimum(n[0][i], n[1]) >= PERCENT * np.maximum(n[0][i], n[1])
        apart = sizes & (roots[1] != roots[0][i])
        at = np.flatnonzero(apart & (bands[1] & bands[0][i] != 0) if banded else apart)
        if banded and len(at):
            same = keys[1][at] == keys[0][i]
            at = at[same.any(axis=1) & (bands[0][i] >> same.argmax(axis=1) & 1 == 1)]
            if not best:
                at = at[(c[1][at] > c[0][i]) | ~np.isin(c[1][at], c[0])]
        if outlines and len(at):
            (bits, shared), (their_bits, their_shared) = outlines
            common = np.bitwise_count(their_bits[at] & bits[i]).sum(axis=1, dtype=np.int64) + np.minimum(their_shared[at], shared[i])
            at = at[100 * common >= PERCENT * (n[0][i] + n[1][at] - common)]
        if len(at):
            # at a similarity below the likeliest the likelihood still rises
            least = PROBABLY[looks[0].shape[1]]
            at = at[_slope(least, looks[0][i][None], looks[1][at], n[0][i] / (n[0][i] + n[1][at])) >= 0]
            others = 0
            if best and len(at):
                others = len(at) - 1
                at = at[[(sketches[1][at] == sketches[0][i]).sum(axis=1).argmax()]]
            for to, what in zip(found, (c[0][i], c[1][at], roots[1][at], group, others)):
                to.append(np.broadcast_to(np.int64(what), len(at)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in found], list(PAIRS))


def _linked(group: int, held: list[pa.Array], passing: list[pa.Array]) -> pa.RecordBatch:
    """``a, b`` of the pairs whose full sets have the similarity."""
    few, many = (side[2].flatten().to_numpy(zero_copy_only=False) for side in (held, passing))
    n_few, n_many = (np.diff(side[2].offsets.to_numpy()) for side in (held, passing))
    order = np.argsort(few, kind="stable")
    owners, few = np.repeat(np.arange(len(n_few)), n_few)[order], few[order]
    values, first = np.unique(few, return_index=True)
    many_held = np.diff(np.append(first, len(few)))
    ends, found = np.cumsum(n_many), []
    start = 0
    while start < len(n_many):  # so many rows that their meetings with all held ones are few enough
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n_many[start] + MEETINGS // len(n_few), side="right")))
        sizes = n_many[start:stop]
        hashes = many[ends[start] - n_many[start] : ends[stop - 1]]
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        hit = np.flatnonzero(values[at] == hashes)
        count = many_held[at[hit]]
        holders = owners[np.repeat(first[at[hit]] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        rows = np.repeat(np.repeat(np.arange(len(sizes)), sizes)[hit], count)
        common = np.bincount(rows * len(n_few) + holders, minlength=len(sizes) * len(n_few)).reshape(len(sizes), len(n_few))
        j, i = np.nonzero(100 * common >= PERCENT * (sizes[:, None] + n_few[None, :] - common))
        found.append((i, start + j))
        start = stop
    i, j = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([held[0].take(pa.array(i)), passing[0].take(pa.array(j))], ["a", "b"])


def _likely(held: DataFrame, passing: DataFrame, classes: DataFrame, banded: bool, best: bool = False) -> DataFrame:
    """The PAIRS of rows ``g, c, root`` (and others of the payload) of either side that may be linked; ``banded``: they have ``bands``."""
    payload = F.struct(*[x for x in [*classes.columns, *held.columns] if x not in ("g", "c", "root")]).alias("sketch")
    sketched = lambda rows: rows.join(classes, "c").select("g", "c", "root", payload)
    kernel = partial(_alike, banded=banded, best=best)
    return materialize(_blocks(sketched(held), sketched(passing), "sketch", kernel, ", ".join(f"{x} bigint" for x in PAIRS), SKETCHES), "likely")


def _confirmed(pairs: DataFrame, group: str, sets: DataFrame) -> DataFrame:
    """``a, b`` of the pairs whose full sets have the similarity; ``group``: what many pairs share."""
    side = lambda x: pairs.select(F.col(group).alias("g"), F.col(x).alias("c")).distinct().withColumn("root", F.lit(0).cast("long")).join(sets, "c")
    return materialize(_blocks(side("a"), side("b"), "members", _linked, "a bigint, b bigint", SETS), "links")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``node, root`` of ``roots`` with the links ``a, b`` added."""
    if roots is None:
        return materialize(connected_components(links, few=FEW), "roots")
    to = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r_{x}"))
    ends = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))
    new = materialize(connected_components(ends, few=FEW), "roots")
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("__to")), "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
    return materialize(moved.unionByName(new.join(roots, "node", "left_anti")), "roots")


def _groups(classes: DataFrame) -> DataFrame:
    """``g, c, bands``: the classes ``c`` that share buckets which are the hub ``g``'s, and a bit for the band of each; a hub is not in its own group.

    A bucket's hub is that of its classes whose buckets are the largest together, so that few hubs serve many buckets.
    A hub most of whose classes have one and the same hub as their best gives that one its buckets: what is alike
    in great numbers has hubs by the hundred, which hold the same classes over and over.
    """
    band = lambda k: F.shiftleft(F.xxhash64(k, F.substring(F.col("sketch"), k * WIDTH + 1, F.lit(WIDTH))), 6) + k
    members = classes.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("key"), "c")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.count("*").alias("__size")).where("size > 1")
    sizes = materialize(sizes, "sizes")
    buckets = materialize(uneven_join(members, sizes, ["key"], "__size", BANDS * classes.count()), "buckets")
    reach = buckets.groupBy("c").agg(F.sum("size").alias("reach"))
    best = F.max(F.struct("reach", (-F.col("c")).alias("c")))
    hubs = materialize(buckets.join(reach, "c").groupBy("key").agg(best.alias("hub"), F.count("*").alias("__size")), "hubs")
    named = uneven_join(buckets, hubs, ["key"], "__size", buckets.count()).groupBy("hub", "c")
    met = named.agg(F.bit_or(F.expr("shiftleft(1L, int(key & 63))")).alias("bands"))
    met = materialize(met.withColumn("best", F.max("hub").over(Window.partitionBy("c"))), "met")  # a class has BANDS hubs at most
    votes = met.groupBy("hub", "best").agg(F.count("*").alias("votes")).groupBy("hub")
    votes = votes.agg(F.sum("votes").alias("__size"), F.max(F.struct("votes", "best")).alias("most"))
    led = votes.select("hub", "__size", F.when(2 * F.col("most.votes") > F.col("__size"), F.col("most.best")).otherwise(F.col("hub")).alias("to"))
    moved = uneven_join(met, materialize(led, "led"), ["hub"], "__size", met.count()).select((-F.col("to.c")).alias("g"), "c", "bands").where("c <> g")
    return materialize(moved.groupBy("g", "c").agg(F.bit_or("bands").alias("bands")), "groups")


def class_components(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], fine_of: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """``node, root`` of the classes that links connect, None if there are none.

    ``classes`` has ``c, n, sketch``; ``sets_of`` gives ``c, members`` of the
    classes ``c`` handed to it, ``fine_of`` their FINE registers as ``c, fine``.
    """
    groups, roots = _groups(classes), None
    own = F.col("c").alias("root")

    def links_of(likely: DataFrame, group: str) -> DataFrame | None:
        """The confirmed ones of ``likely``, None if there are none."""
        if likely.isEmpty():
            return None
        ends = likely.select(F.col("a").alias("c")).distinct().union(likely.select("b").distinct()).distinct()
        sets = sets_of(ends)
        links = _confirmed(likely, group, sets)
        discard(sets)
        return None if links.isEmpty() else links

    # each class and its buckets' hubs
    likely = _likely(groups.select("g", F.col("g").alias("c")).distinct().select("*", own), groups.select("g", "c", own), classes, False)
    links = links_of(likely, "a")
    roots = links and _joined(None, links)
    discard(likely)
    # what is left apart in a group, where the hub has met all others: first each with its best, then those that had more with all
    left, again = groups, None
    for best in (True, False):
        if roots is None:
            named = left.select("g", "c", "bands", own)
        else:
            named = left.join(roots.withColumnRenamed("node", "c"), "c", "left").select("g", "c", "bands", F.coalesce("root", "c").alias("root"))
        named = materialize(named, "left")
        parts = named.groupBy("g", "root").agg(F.count("*").alias("size")).groupBy("g")
        most = parts.agg(F.count("*").alias("parts"), F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("size")).where("parts > 1")
        most = materialize(most.select("g", F.col("most.root").alias("most"), "size"), "most")
        if most.isEmpty():
            return roots
        total = named.count()
        apart = materialize(uneven_join(named, most, ["g"], "size", total), "left")
        discard(named)
        known, rows = classes, apart
        if not best:
            ends = apart.select("c").union(apart.select("g")).distinct()
            sets = sets_of(ends)
            rows = rows.join(_outlined(rows, sets, most.select("g", "size"), total), ["g", "c"])
            discard(sets)
            known = classes.join(fine_of(apart.select("c").distinct()), "c")
        held = rows.where("root <> most") if best else rows.join(again, ["g", "c"], "left_semi")
        likely = _likely(held.drop("most"), rows.drop("most"), known, True, best)
        links = links_of(likely, "b" if best else "root")  # one pair for each held row, or many
        roots = roots if links is None else _joined(roots, links)
        if best:  # who had one partner has been confirmed or not
            again = materialize(likely.where("more > 0").select("g", F.col("a").alias("c")).distinct(), "again")
            left = uneven_join(apart.select("g", "c", "bands"), most.join(again.select("g").distinct(), "g", "left_semi").drop("most"), ["g"], "size", total)
        discard(likely)
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for each row of ``docs``.

    Texts are linked if their sets of shingles have a similarity of at least
    PERCENT hundredths; ``component_id`` is the smallest id that links reach and
    ``kept`` says whether it is the row's own. A text without words (null, empty,
    blank) has no shingles, no links and its own id as ``component_id``. Rows
    whose id repeats are kept, each with its own text's links; a null id takes part in
    links but is never the smallest, and a component of null ids alone has a null
    ``component_id`` and is not ``kept``. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    prints = rows.select("id", *_text_key(), F.col("text").cast("binary").alias("text"))
    prints = materialize(prints.mapInArrow(_sketched, f"id {kind}, t1 bigint, t2 bigint, n bigint, k binary, sketch binary"), "sketches")
    first = [F.first(c).alias(c) for c in ("t1", "t2", "n", "sketch")]
    classes = prints.where("n > 0").groupBy("k").agg(*first, F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    def made_of(wanted: DataFrame, of: Callable[[np.ndarray], object], kind: pa.DataType, name: str, declared: str) -> DataFrame:
        keys = materialize(classes.join(wanted, "c").select("c", "t1", "t2"), "wanted")
        texts = may_hold(rows.select("text", *_text_key()), keys, ["t1", "t2"], keys.count()).dropDuplicates(["t1", "t2"]).join(keys, ["t1", "t2"])
        made = texts.select("c", F.col("text").cast("binary").alias("text")).mapInArrow(partial(_made, of=of, kind=kind), f"c bigint, made {declared}")
        return materialize(made.withColumnRenamed("made", name), name)

    def sets_of(wanted: DataFrame) -> DataFrame:
        return made_of(wanted, lambda hashes: hashes.view(np.int64), pa.list_(pa.int64()), "members", "array<bigint>")

    def fine_of(wanted: DataFrame) -> DataFrame:
        return made_of(wanted, lambda hashes: registers(hashes, FINE).tobytes(), pa.binary(), "fine", "binary")

    roots = class_components(classes.select("c", "n", "sketch"), sets_of, fine_of)
    rooted = classes.select("c", "k", "least", "copies", F.col("c").alias("root"))
    if roots is not None:
        rooted = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "k", "least", "copies", F.coalesce("root", "c").alias("root"))
    rooted = materialize(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__size"))
    named = uneven_join(rooted, names, ["root"], "__size", classes.count()).select("k", "component_id", "copies")
    found = uneven_join(prints.where("n > 0").select("id", "n", "k"), named, ["k"], "copies", prints.count())
    found = found.select("id", "n", "component_id").unionByName(prints.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
