"""Benchmark decontamination: near pairs of words as seeds, then Smith-Waterman alignment.

Texts and test items are word sequences (letters, digits and underscores, lower
case). A copy's score is that of the best local alignment over the item's own.

What is aligned follows from the threshold and loses nothing. Between successive
matches an alignment of an item of L words pays at least the larger of the two
gaps, so if it scores ``threshold`` or more, at least ``need = ceil(threshold * L) - 1``
successive matches are near: one or two words apart in the item and in the text.
Each starts at another word of the item. Of the places where near pairs start,
``need - k`` may thus be left out, those of pairs that are most frequent in the
block's items, and each copy still has ``k`` of the others within the length that
a copy can have. That holds for each copy by itself, whatever is left out: the
choice decides on the work only. One scan of the corpus finds the spots with ``k``
pairs of an item and aligns the passages around them.

Items of fewer than NGRAM words have no near pair that each copy must hold; their
seeds are single words. A copy matches at least ``ceil(threshold * L)`` of the
item's words, so it holds one even if all but one of so many are left out.

Test items come in blocks, each with a scan of its own: what a scan broadcasts
is bounded by ``block_ngrams``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.batches import small_batches
from wayline.storage import materialize

#: Words in a row that copies share unless the caller asks for no run; shorter items have single words for seeds.
NGRAM = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: A passage holds a leak if its alignment scores at least this share of the item's own score.
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")
_CHUNK = 1 << 20
_FACTORS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)]
_MASK_BITS = 20
_LOW = np.uint64((1 << _MASK_BITS) - 1)


class _Hashes(dict):
    """Word to 64-bit hash; starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _chunks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of a text that cut no word and have about _CHUNK characters."""
    start = 0
    while start < len(text):
        end = min(start + _CHUNK, len(text))
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        yield start, end
        start = end


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a sequence of word hashes."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += words[k : k + size] * np.uint64(_FACTORS[k])
    return out


class Text:
    """A text's word hashes; its words are made again, chunk by chunk, where they are asked for."""

    def __init__(self, text: str | None, memo: _Hashes) -> None:
        self.text = text or ""
        self.spans, parts, self.first = [], [], [0]
        for a, b in _chunks(self.text):
            words = _WORD.findall(self.text[a:b].lower())
            parts.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
            self.spans.append((a, b))
            self.first.append(self.first[-1] + len(words))
        self.hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def words(self, start: int, end: int) -> list[str]:
        out: list[str] = []
        for (a, b), low, high in zip(self.spans, self.first, self.first[1:]):
            if low < end and high > start:
                words = _WORD.findall(self.text[a:b].lower())
                out += words[max(0, start - low) : end - low]
        return out


def near_pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of words that are one and two apart, by the place of the first."""
    left, right = words * np.uint64(_FACTORS[0]), words * np.uint64(_FACTORS[1])
    return left[:-1] + right[1:], left[:-2] + right[2:]


def single_words(words: np.ndarray) -> np.ndarray:
    """Hashes of words as seeds of their own."""
    return words * np.uint64(_FACTORS[2])


class Seeds:
    """The pairs of a block of items: sorted hashes, and for each the items that have it (``owners[first[k] : first[k + 1]]``).

    ``single``: some of them are single words.
    """

    def __init__(self, pairs: np.ndarray, owners: np.ndarray, single: bool = False) -> None:
        self.single = single
        order = np.lexsort((owners, pairs))
        pairs, owners = pairs[order], owners[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]) | (owners[1:] != owners[:-1])
        pairs, self.owners = pairs[new], owners[new]
        self.hashes, first = np.unique(pairs, return_index=True)
        self.first = np.append(first, len(pairs))

    def mask(self) -> np.ndarray:
        maybe = np.zeros(1 << _MASK_BITS, bool)
        maybe[(self.hashes & _LOW).astype(np.int64)] = True
        return maybe

    def hits(self, words: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text where pairs start, and which (an index into ``hashes``)."""
        places, which = [], []
        for found in (*near_pairs(words), *([single_words(words)] if self.single else [])):
            at = np.flatnonzero(maybe[(found & _LOW).astype(np.int64)])
            if len(at):
                k = np.minimum(np.searchsorted(self.hashes, found[at]), len(self.hashes) - 1)
                real = self.hashes[k] == found[at]
                places.append(at[real])
                which.append(k[real])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places), np.concatenate(which)


class Item:
    """A test item: its least score and how its copies are found."""

    def __init__(self, item_id: int | None, words: str, threshold: float) -> None:
        self.item_id, self.text = item_id, words
        own = self.words()
        self.hashes = np.fromiter(map(_Hashes().__getitem__, own), np.uint64, len(own))
        size = len(own)
        need = math.ceil(threshold * size - 1e-9) - 1
        self.short = size < NGRAM
        self.k = 1 if self.short else max(1, need // 2)
        self.left_out = max(0, need) if self.short else need - self.k
        self.span = size * 3 - math.ceil(MATCH * threshold * size - 1e-9)  # the longest passage that a copy takes

    def words(self) -> list[str]:
        return self.text.split(" ")

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place but the last the pairs that start there, the second being the first again where there is none; words of a short item."""
        if self.short:
            return (single_words(self.hashes),) * 2
        one, two = near_pairs(self.hashes)
        return one, np.append(two, one[-1:])


def _counted(hashes: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """How often a hash occurs in all of ``hashes``."""
    values, counts = np.unique(np.concatenate(hashes), return_counts=True)
    return lambda x: counts[np.searchsorted(values, x)]


def _seeds(items: list[Item]) -> Seeds:
    """The pairs by which each item's copies are found: those that are rarest in all items, then those of rarer words."""
    pairs, single = [item.pairs() for item in items], any(item.short for item in items)
    often, words = _counted([x for two in pairs for x in two]), _counted([item.hashes for item in items])
    kept, owners = [], []
    for k, (item, two) in enumerate(zip(items, pairs)):
        of = words(item.hashes)
        places = np.lexsort((of if item.short else of[:-1] * of[1:], sum(map(often, two))))[: len(two[0]) - item.left_out]
        kept += [x[places] for x in two]
        owners += [np.full(len(places), k, np.int32)] * 2
    return Seeds(np.concatenate(kept), np.concatenate(owners), single)


def _spots(places: np.ndarray, which: np.ndarray, seeds: Seeds, k: np.ndarray, span: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Items that have ``k`` of their pairs within ``span`` words of a text, and where such groups start."""
    many = seeds.first[which + 1] - seeds.first[which]
    at = np.repeat(seeds.first[which] - np.cumsum(many) + many, many) + np.arange(many.sum())
    owner, place = seeds.owners[at].astype(np.int64), np.repeat(places, many)
    both = np.unique(owner << 40 | place)  # a place counts once for an item
    owner, place = both >> 40, both & ((1 << 40) - 1)
    last = np.arange(len(both)) + k[owner] - 1
    end = np.minimum(last, len(both) - 1)
    near = (last < len(both)) & (owner[end] == owner) & (place[end] - place <= span[owner])
    owner, place = owner[near], place[near]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for own, group in zip(np.split(owner, cuts), np.split(place, cuts)):
        if len(own):
            yield int(own[0]), group


def _passages(starts: np.ndarray, span: int, total: int) -> Iterator[tuple[int, int]]:
    """Passages that hold all that reaches ``span`` words from a start; those that touch are one."""
    for group in np.split(starts, np.flatnonzero(np.diff(starts) > 2 * span) + 1):
        yield max(0, int(group[0]) - span), min(total, int(group[-1]) + span + 1)


def align(item: list[str], passage: list[str]) -> tuple[int, int]:
    """Score of the best local alignment of two word sequences and where it ends in the second (Smith-Waterman, linear gaps)."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
    there = np.fromiter((ids.get(w, -1) for w in passage), np.int64, len(passage))
    slope = np.arange(1, len(there) + 1) * -GAP
    row = np.zeros(len(there) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        step = np.where(there == ids[w], MATCH, MISMATCH)
        cell = np.maximum(np.maximum(row[:-1] + step, row[1:] + GAP), 0)
        row[1:] = np.maximum(np.maximum.accumulate(cell + slope) - slope, 0)  # gaps along the passage
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _aligned(docs: DataFrame, keys: list[str], items: list[Item], seeds: Seeds, threshold: float, n: int) -> DataFrame:
    """``keys, item_id, score, start, end`` of the passages whose alignment reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((items, seeds))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = shared.value
        k, span = (np.array([getattr(x, c) for x in items], np.int64) for c in ("k", "span"))
        memo, maybe = _Hashes(), seeds.mask()
        for batch in batches:
            kept, found = [], []
            for i in range(batch.num_rows):
                text = Text(batch.column(len(keys))[i].as_py(), memo)
                places, which = seeds.hits(text.hashes, maybe)
                if not len(places):
                    continue
                for own, starts in _spots(places, which, seeds, k, span):
                    item = items[own]
                    mine = item.words()
                    for start, end in _passages(starts, item.span, len(text.hashes)):
                        words = text.words(start, end)
                        best, last = align(mine, words)
                        score = best / (MATCH * len(mine))
                        run = min(n, len(mine))
                        if score < threshold or run > 1 and not np.isin(ngram_hashes(item.hashes, run), ngram_hashes(text.hashes, run)).any():
                            continue
                        _, back = align(mine[::-1], words[:last][::-1])
                        kept.append(i)
                        found.append((item.item_id, score, start + last - back, start + last))
            if kept:
                arrays = batch.select(list(range(len(keys)))).take(pa.array(kept, pa.int64())).columns
                more = [pa.array(x, kind) for x, kind in zip(zip(*found), (pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*arrays, *more], [*keys, "item_id", "score", "start", "end"])

    extra = T._parse_datatype_string("item_id bigint, score double, start bigint, end bigint").fields
    schema = T.StructType([*docs.select(*keys).schema.fields, *extra])
    return small_batches(docs.select(*keys, F.col("text").alias("__text"))).mapInArrow(rows, schema)


def _item_words(items: DataFrame) -> DataFrame:
    """``item_id, words, size`` of test items with at least one word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_WORD.findall((t.as_py() or "").lower()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(w) for w in words], pa.string()), pa.array([len(w) for w in words], pa.int64())], ["item_id", "words", "size"])

    made = items.select(F.col("item_id").cast("long"), "text").mapInArrow(rows, "item_id bigint, words string, size bigint")
    return made.where(F.col("size") > 0).distinct()


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    threshold: float = THRESHOLD,
    n: int = NGRAM,
    block_ngrams: int = 4_000_000,
) -> DataFrame:
    """``keys, item_id, score, start_word, end_word``: documents that hold a copy, whole or edited, of a test item.

    ``docs`` has ``keys`` and ``text``, ``items`` ``item_id`` and ``text``. One row
    for each key and item, that of the best passage (ties: the first). The score
    is 1 for an exact copy; words are counted from 0, the end is excluded. A
    document counts if it shares ``n`` consecutive words with the item, or all of an
    item that has fewer; with 1 the score alone decides.

    Null and empty texts hold nothing, items without a word match nothing. An item
    of one or two words scores 0.5 with one of its words; who has such items and
    wants them whole asks for more words in a row. A repeated item counts once, a null item id is an
    id like any other. Rows that share a key, a null one too, are one document.
    Columns besides these are ignored; empty tables give an empty result.
    """
    if threshold * NGRAM <= 1:
        raise ValueError("copies that score so little need not hold a near pair")
    keys = list(keys)
    made = materialize(_item_words(items), "item-words")
    total = made.agg(F.sum(2 * F.col("size"))).first()[0] or 0
    blocks = max(1, -(-total // block_ngrams))
    scored = None
    for k in range(blocks):
        own = made if blocks == 1 else made.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k)
        block = [Item(r.item_id, r.words, threshold) for r in own.select("item_id", "words").collect()]  # block_ngrams pairs or so
        if not block:
            continue
        leaks = _aligned(docs, keys, block, _seeds(block), threshold, n)
        scored = leaks if scored is None else scored.unionByName(leaks)
    if scored is None:
        kinds = docs.select(*keys).limit(0)
        return kinds.select(*keys, *(F.lit(0).cast(t).alias(c) for c, t in (("item_id", "long"), ("score", "double"), ("start_word", "long"), ("end_word", "long"))))
    best = F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"))).alias("best")
    return scored.groupBy(*keys, "item_id").agg(best).select(
        *keys, "item_id", F.col("best.score").alias("score"), F.col("best.start").alias("start_word"), F.col("best.end").alias("end_word")
    )
