"""Runs of words that repeat with a period, and texts with each run cut to one period.

A run is a maximal stretch of words with smallest period ``q`` (words ``q`` apart
are identical). They are found on the harmonic grid: a stretch with period ``p``
and at least ``3 * p`` words holds a grid point ``i = j * p`` among its first
``p`` words, and there the words from ``i`` and from ``i + p`` on go together for
at least ``p`` words, those before them back to the run's start. So one forward
and one backward query of the longest common extension (LCE) at each pair
``(j * p, (j + 1) * p)`` gives every run; there are ``n * ln(n)`` pairs in a text
of ``n`` words. An LCE is a range minimum over the common prefixes of neighbours
in a suffix array; the backward ones use the array of the reversed words.

Several texts share one array: the codes of their words differ, so nothing is
common to two texts. Texts are gathered until they have BLOCK words; a longer one
is a block of its own, which takes about ``16 * log2(n)`` bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs are at least this long and hold at least so many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Words handled at once, and grid pairs looked at at once.
BLOCK, PAIRS = 1 << 16, 1 << 21

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Extensions:
    """Longest common extensions of positions in an array of codes."""

    def __init__(self, codes: np.ndarray, reach: int):
        """``reach``: two positions asked about are never further apart in the suffix array."""
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        rank, levels, ahead = np.full(n + 1, -1, np.int64), [], 1
        slots, keys, moved = np.arange(n), codes[order], order
        suffixes = order.copy()
        while True:
            # groups of equal keys start where keys change; a rank is the slot of the group's first
            fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
            rank[moved] = np.maximum.accumulate(np.where(fresh, slots, 0))
            suffixes[slots] = moved
            levels.append(rank.astype(np.int32))
            open_ = ~(fresh & np.concatenate([fresh[1:], [True]]))
            slots, moved = slots[open_], moved[open_]
            if not len(slots):
                break
            keys = rank[moved] * (n + 1) + rank[np.minimum(moved + ahead, n)] + 1
            by = np.argsort(keys, kind="stable")
            keys, moved = keys[by], moved[by]
            ahead *= 2
        self.rank = levels[-1]
        common = np.zeros(n, np.int32)
        near = np.flatnonzero(levels[0][suffixes[:-1]] == levels[0][suffixes[1:]])
        a, b, found = suffixes[near], suffixes[near + 1], np.zeros(len(near), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
            a, b, found = a + step, b + step, found + step
        common[near] = found
        del levels
        self.least = [common]
        while 2 << (len(self.least) - 1) <= min(reach, n):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[-half:]]))
        self.least = np.stack(self.least)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the codes from ``a`` on and from ``b`` on agree; ``a`` and ``b`` differ."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.least[k, low], self.least[k, high - (1 << k)])


def _grid(lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and periods of the grid's pairs in bounded blocks."""
    most = np.where(lengths >= MIN_WORDS, lengths // MIN_PERIODS, 0)
    doc = np.repeat(np.arange(len(lengths)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (lengths[doc] - 1) // period
    block = (np.cumsum(pairs) - pairs) // PAIRS
    for rows in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(block)) + 1) if len(doc) else []:
        count = pairs[rows]
        p = np.repeat(period[rows], count)
        j = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(starts[doc[rows]], count) + j * p, p


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each list of words, by start, then period."""
    codes, base = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        codes.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        base += len(seen)
    lengths = np.array([len(c) for c in codes], np.int64)
    starts = np.cumsum(lengths) - lengths
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(lengths) or lengths.max() < MIN_WORDS:
        return found
    whole, reach = np.concatenate(codes), int(lengths.max())
    n, forward, backward = len(whole), Extensions(whole, reach), None
    ends = starts + lengths
    first = np.zeros(n, bool)
    first[starts[lengths > 0]] = True
    best: dict[tuple[int, int], int] = {}
    for i, p in _grid(lengths, starts):
        same = whole[i] == whole[i + p]
        i, p = i[same], p[same]
        ahead = forward.common(i, i + p)
        i, p, ahead = i[ahead >= p], p[ahead >= p], ahead[ahead >= p]
        if not len(i):
            continue
        if backward is None:
            backward = Extensions(whole[::-1].copy(), reach)
        behind = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(~first[i])
        behind[inner] = backward.common(n - i[inner], n - i[inner] - p[inner])
        start, end = i - behind, i + p + ahead
        # a run shows at its first grid point alone
        good = (behind < p) & (end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * p))
        for s, e, q in zip(start[good].tolist(), end[good].tolist(), p[good].tolist(), strict=True):
            best[s, e] = min(q, best.get((s, e), q))
    for (s, e), q in sorted(best.items(), key=lambda x: (x[0][0], x[1])):
        d = int(np.searchsorted(ends, s, side="right"))
        found[d].append((s - int(starts[d]), e - s, q))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space apart, without those that lie in a run after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None

    def out(batch: pa.RecordBatch, at: int, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = find_runs(texts)
        kept = batch.slice(at, len(texts)).columns[:-1]
        dicts = [[{"start": s, "length": n, "period": q} for s, n, q in of] for of in runs]
        more = [pa.array(dicts, schema.field("runs").type), pa.array(list(map(collapse, texts, runs)), pa.binary())]
        return pa.RecordBatch.from_arrays([*kept, *more], schema=schema)

    for batch in batches:
        if schema is None:
            run = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
            schema = pa.schema([*list(batch.schema)[:-1], ("runs", pa.list_(run)), ("collapsed", pa.binary())])
        at, held, size = 0, [], 0
        for k in range(batch.num_rows):
            held.append((batch.column(batch.num_columns - 1)[k].as_py() or b"").split())
            size += len(held[-1])
            if size >= BLOCK:
                yield out(batch, at, held)
                at, held, size = k + 1, [], 0
        if held:
            yield out(batch, at, held)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``runs`` and ``collapsed``; columns of these names are replaced.

    ``runs``: an array of start, length and period in words, numbered from 0, of
    all runs of at least MIN_WORDS words and MIN_PERIODS periods, by start, then
    period. ``collapsed``: the words kept when each run loses all after its first
    period, one space apart. Words are what ASCII white space (space, tab to
    carriage return) parts. A null, empty or blank text has no run and an empty
    ``collapsed``. Whole texts are read, each in one task; rows that repeat are
    kept as they are; an empty table stays empty.
    """
    kept = [F.col(c) for c in docs.columns if c not in (text, "runs", "collapsed")]
    rows = docs.select(*kept, F.col(text).cast("binary").alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    found = rows.mapInArrow(_apply, ", ".join([*schema, f"runs array<{RUN}>", "collapsed binary"]))
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """Of an array of runs the one with the greatest length / period, compared exactly; then the first start, then the smallest period."""

    def before(a: Column, b: Column) -> Column:
        apart = b["length"] * a["period"] - a["length"] * b["period"]
        return F.coalesce(
            F.nullif(F.sign(apart), F.lit(0.0)), F.nullif(F.sign(a["start"] - b["start"]), F.lit(0.0)), F.sign(a["period"] - b["period"])
        ).cast("int")

    return F.get(F.array_sort(runs, before), F.lit(0))
