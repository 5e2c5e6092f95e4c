"""SimHash near-duplicates with pigeonring filtering.

A document's 64-bit fingerprint sets a bit if more than half of its word-shingle
hashes set it. Two fingerprints that differ in at most TAU = 2 bits are linked.

Cut the 64 bits into a ring of M = 3 segments. If two fingerprints differ in at
most TAU bits, then some segment starts a chain around the ring whose first l
segments differ in at most ``l * TAU / M`` bits, for every l: 0 bits over one
segment, at most 1 over two, at most 2 over all three. The chain's first two
segments are the index: the first exact, the second with no or one position
masked, which makes 66 keys a fingerprint, each of more than 40 fixed bits. So
candidates stay few however many fingerprints there are, and what shares a key
differs at most in the third segment and the masked bit, at most 2**23 values
(64 MB, some 400 MB while one task compares them).
Within a key the chain is continued and the full distance checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.components import connected_components
from wayline.storage import materialize

SEED = 42
TAU = 2
#: Lengths of the ring's segments, from the lowest bit.
SEGMENTS = (21, 21, 22)
#: A key's group up to this size is compared pair by pair, a larger one by masked values.
PAIRWISE = 64
_BLOCK = 1 << 20


def word_blocks(data: bytes, carry: int) -> Iterator[list[bytes]]:
    """Words of ``data`` in bounded lists; each list starts with the last ``carry`` words of the one before."""
    start, tail, space = 0, [], b" \t\n\x0b\x0c\r"
    while start < len(data):
        end = min(start + _BLOCK, len(data))
        while end < len(data) and data[end] not in space:
            end += 1
        words = tail + data[start:end].split()
        start = end
        yield words
        tail = words[-carry:] if carry else []


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text; 0 if it has no words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, total = np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for words in word_blocks(data, shingle - 1):
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        cuts = map(slice, starts, (ends[shingle - 1 :] - 1).tolist())
        n = len(words) - shingle + 1
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, n)
        for k in range(0, n, 65536):
            part = h[k : k + 65536].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, to: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long in column ``to``.

    Null and empty texts have fingerprint 0. Other columns pass through.
    """

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(to, of(F.col(text)))


def _keyed(distinct: DataFrame) -> DataFrame:
    """``variant, key, fp``: for each rotation, the first two segments with no or one bit of the second masked."""
    rotations, at = [], 0
    for k, length in enumerate(SEGMENTS):
        second = SEGMENTS[(k + 1) % len(SEGMENTS)]
        turned = (
            F.expr(f"shiftrightunsigned(fp, {at}) | shiftleft(fp, {64 - at})") if at else F.col("fp")
        )
        fixed = (1 << (length + second)) - 1
        masks = [fixed] + [fixed & ~(1 << (length + p)) for p in range(second)]
        rotations += [
            F.struct(F.lit(32 * k + j).cast("short").alias("variant"), turned.bitwiseAND(F.lit(m)).alias("key"))
            for j, m in enumerate(masks)
        ]
        at += length
    return distinct.select("fp", F.inline(F.array(*rotations)))


def _chains(variant: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within one key's group. Those not found here have another rotation's chain or variant."""
    k, masked = divmod(variant, 32)
    lengths = [SEGMENTS[(k + j) % 3] for j in range(3)]
    at = np.uint64(sum(SEGMENTS[:k]))
    turned = (fps >> at) | (fps << (np.uint64(64) - at)) if k else fps
    third = turned >> np.uint64(lengths[0] + lengths[1])
    # of a group with a masked bit only pairs that differ there are new; these may differ in one bit more
    side = (turned >> np.uint64(lengths[0] + masked - 1)) & np.uint64(1) if masked else np.zeros_like(fps)
    left = TAU - bool(masked)
    if len(fps) <= PAIRWISE:
        apart = np.bitwise_count(third[:, None] ^ third[None, :])
        i, j = np.nonzero(np.triu((apart <= left) & ((side[:, None] != side[None, :]) if masked else True), 1))
        return fps[i], fps[j]
    bits = [np.uint64(1 << p) for p in range(lengths[2])]
    masks = bits if left == 1 else [x | y for n, x in enumerate(bits) for y in bits[:n]]
    found_a, found_b = [], []
    for m in masks:  # equal under a mask of at most ``left`` bits: at most TAU bits apart, so each hangs on its neighbour
        value = third & ~m
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        found_a.append(fps[order][:-1][same])
        found_b.append(fps[order][1:][same])
    return np.concatenate(found_a), np.concatenate(found_b)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by variant and key; a run may go on in the next batch."""
    held: list[tuple[np.ndarray, ...]] = []

    def links(variant: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((variant[1:] != variant[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        many = np.flatnonzero(ends - starts > 1)
        found = [_chains(int(variant[starts[r]]), fp[starts[r] : ends[r]]) for r in many]
        a = np.concatenate([x[0] for x in found] or [np.empty(0, np.uint64)]).view(np.int64)
        b = np.concatenate([x[1] for x in found] or [np.empty(0, np.uint64)]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def whole() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([h[i] for h in held]) for i in range(3))

    for batch in batches:
        if not batch.num_rows:
            continue
        new = (
            batch.column(0).to_numpy(zero_copy_only=False),
            batch.column(1).to_numpy(zero_copy_only=False),
            batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64),
        )
        last = int(np.flatnonzero(np.concatenate([[True], (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])]))[-1])
        if held and last == 0 and held[-1][0][-1] == new[0][0] and held[-1][1][-1] == new[1][0]:
            held.append(new)  # one run as long as the batch
            continue
        held.append(tuple(x[:last] for x in new))
        yield links(*whole())
        held = [tuple(x[last:] for x in new)]
    if held:
        yield links(*whole())


def near_links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links that connect all of the distinct fingerprints ``fp`` that TAU bits or fewer join.

    In small groups every pair; in large ones enough pairs to connect them. Each has at most TAU bits apart.
    """
    keyed = _keyed(distinct).repartition("variant", "key").sortWithinPartitions("variant", "key")
    return keyed.select("variant", "key", "fp").mapInArrow(_runs, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col, fingerprint, component_id`` for each row of ``docs``.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest id that
    links reach. Null or empty texts share fingerprint zero and are linked like
    any other. Repeated ids and rows are kept, each with its own fingerprint. A
    null id takes part in links but is never the smallest; a component of
    null ids alone has a null ``component_id``. Ties cannot arise; an empty table
    gives an empty result; other columns are ignored.
    """
    prints = materialize(
        fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), shingle=shingle).drop("text"),
        "fingerprints",
    )
    least = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "least")
    roots = connected_components(near_links(least.select("fp")))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
