"""Byte-level BPE encoding and decoding.

Text is split by a pre-token pattern; each pre-token's bytes are merged in order
of rank. The merge queue is a hierarchical bitmap over ranks: one bucket per rank
that occurs holds the linked-list positions of its pairs, finding the first set
bit level by level gives the least rank, and an entry that an earlier merge made
stale is skipped when it comes up. Work is near linear in the length of a
pre-token, so a run of a million letters is no special case. The queue runs once
for all unknown pre-tokens of some megabyte of text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import batched, compress, pairwise, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.batches import small_batches

#: The memo of pre-tokens: entries, and characters of one entry, at most.
_MEMO, _MEMO_CHARS = 400_000, 48
#: Characters of text, or bytes of ids, taken at once; longer texts are taken alone.
_AT_ONCE = 1 << 20


class Merger:
    """Merges pre-tokens by a rank queue of three bitmap levels.

    A bit of ``words`` stands for a rank, one of ``blocks`` for a word that has a
    bit set, one of ``top`` for such a block. ``buckets`` has, for each rank whose
    bit is set, the positions of its pairs as a heap, leftmost first. The queue is
    empty between calls.

    All pre-tokens of a call share one linked list, with a position between any
    two that pairs with nothing, so none can reach into another: what is taken
    from the queue next for one of them doesn't depend on the others. First pairs
    are looked up by two byte values, later ones by two ids.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, most = ranks, max(ranks.values())
        self.words = [0] * ((most >> 6) + 1)
        self.blocks = [0] * ((most >> 12) + 1)
        self.base = most + 2
        self.wall = most + 1  # the id of what stands between pre-tokens
        of = ranks.get
        self.single = np.array([of(bytes([b]), -1) for b in range(256)], np.int32)
        self.first = np.full(1 << 16, -1, np.int32)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = rank
            for k in range(1, len(token)):
                left, right = of(token[:k]), of(token[k:])
                if left is not None and right is not None:
                    self.pairs[left * self.base + right] = rank

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit words; none may be empty."""
        ids, starts = self._merged(pieces)
        raw, cuts = ids.astype("<u4").tobytes(), (starts * 4).tolist()
        return [raw[a:z] for a, z in pairwise(cuts)]

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, and where each one's begin, with the end."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        walls = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        inner = np.ones(len(data), bool)
        inner[walls] = False
        token = self.single[data]
        if (token[inner] < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        token[walls] = self.wall
        pair = self.first[data[:-1].astype(np.int32) << 8 | data[1:]]
        pair[~(inner[:-1] & inner[1:])] = -1
        left = self._run(token, pair)
        live = left >= 0
        live[walls] = False
        return left[live], np.concatenate([[0], np.cumsum(live)])[walls]

    def _run(self, first_ids: np.ndarray, first_pairs: np.ndarray) -> np.ndarray:
        """Runs the queue until it is empty; ids by position, -1 where one was merged into that before it."""
        n = len(first_ids)
        store = lambda x: array("i", x.astype(np.int32).tobytes())  # noqa: E731 (four bytes a position)
        token, pair = store(first_ids), store(np.append(first_pairs, -1))  # of a part: its id, the rank of the pair that starts here
        following, before = store(np.arange(1, n + 1)), store(np.arange(-1, n))
        get, base, words, blocks = self.pairs.get, self.base, self.words, self.blocks
        at = np.flatnonzero(first_pairs >= 0)
        at = at[np.argsort(first_pairs[at], kind="stable")]
        by_rank = first_pairs[at]
        cuts = np.flatnonzero(np.diff(by_rank, prepend=-1))
        buckets = {r: x.tolist() for r, x in zip(by_rank[cuts].tolist(), np.split(at, cuts[1:]))}
        top = 0
        for r in buckets:
            words[r >> 6] |= 1 << (r & 63)
            blocks[r >> 12] |= 1 << (r >> 6 & 63)
            top |= 1 << (r >> 12)
        while top:
            # the first set bit, level by level
            block = (top & -top).bit_length() - 1
            bits = blocks[block]
            word = block << 6 | ((bits & -bits).bit_length() - 1)
            bits = words[word]
            rank = word << 6 | ((bits & -bits).bit_length() - 1)
            bucket = buckets[rank]
            while bucket:
                i = heappop(bucket)
                if pair[i] != rank:
                    continue  # stale
                gone = following[i]
                after = following[gone]
                prior = before[i]
                following[i] = after
                before[after] = i
                token[gone] = pair[gone] = -1
                token[i] = rank
                lower = False
                pair[i] = new = get(rank * base + token[after], -1)
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        words[new >> 6] |= 1 << (new & 63)
                        blocks[new >> 12] |= 1 << (new >> 6 & 63)
                        top |= 1 << (new >> 12)
                    lower = new < rank
                pair[prior] = new = get(token[prior] * base + rank, -1)
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], prior)
                    else:
                        buckets[new] = [prior]
                        words[new >> 6] |= 1 << (new & 63)
                        blocks[new >> 12] |= 1 << (new >> 6 & 63)
                        top |= 1 << (new >> 12)
                    lower = lower or new < rank
                if lower:
                    break  # it comes before the rest of this bucket
            if not bucket:
                del buckets[rank]
                words[word] &= ~(1 << (rank & 63))
                if not words[word]:
                    blocks[block] &= ~(1 << (word & 63))
                    if not blocks[block]:
                        top &= ~(1 << block)
        return np.frombuffer(token, np.int32)


class Codec:
    """A rank file and a pre-token pattern, ready to use.

    ``memo`` has the ids of pre-tokens, as little-endian 32-bit words. When it is
    full, what was not used since the last time goes.
    """

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.words = {token: struct.pack("<I", rank) for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.merge = Merger(self.ranks)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, missing: set[str]) -> list[str]:
        """Puts pre-tokens into the memo; those too long to stay there are given back."""
        memo, older, words, unknown, size = self.memo, self.older, self.words, [], 0
        raw: list[bytes] = []

        def merge() -> None:
            memo.update(zip(unknown, self.merge(raw)))
            unknown.clear()
            raw.clear()

        for piece in missing:
            ids = older.get(piece)
            if ids is None:
                data = piece.encode("utf-8", "surrogatepass")
                ids = words.get(data)
                if ids is None:
                    unknown.append(piece)
                    raw.append(data)
                    size += len(data)
                    if size > _AT_ONCE:
                        merge()
                        size = 0
                    continue
            memo[piece] = ids
        if unknown:
            merge()
        return [p for p in missing if len(p) > _MEMO_CHARS]

    def _ids(self, pieces: list[str], ends: list[int]) -> list[bytes]:
        """Ids of consecutive texts, whose pre-tokens end at ``ends``."""
        every = list(map(self.memo.get, pieces))
        missing = set(compress(pieces, map(is_, every, repeat(None))))
        if missing:
            if len(self.memo) + len(missing) > _MEMO:
                self.older, self.memo = self.memo, {}
                missing = set(pieces)
            long = self._learn(missing)
            every = list(map(self.memo.__getitem__, pieces))
            for piece in long:
                del self.memo[piece]
        return [b"".join(every[a:z]) for a, z in pairwise([0, *ends])]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for a null or empty text."""
        out: list[bytes] = []
        pieces: list[str] = []
        ends: list[int] = []
        size = 0

        def flush() -> None:
            out.extend(self._ids(pieces, ends))
            pieces.clear()
            ends.clear()

        for text in texts:
            text = text or ""
            if len(text) > _AT_ONCE:  # split match by match instead of into one list
                flush()
                size = 0
                matches = (m.group() for m in self.pattern.finditer(text))
                out.append(b"".join(self._ids(list(some), [len(some)])[0] for some in batched(matches, 65536)))
                continue
            pieces += self.pattern.findall(text)
            ends.append(len(pieces))
            size += len(text)
            if size > _AT_ONCE:
                flush()
                size = 0
        flush()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that the ids stand for; an unknown id raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    def decode_many(self, rows: list[bytes | None]) -> list[bytes]:
        return list(map(self.decode, rows))


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _parts(batch: pa.RecordBatch, index: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch that hold some megabyte together, or one row that holds more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, more in enumerate(sizes.tolist()):
        if size and size + more > _AT_ONCE:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += more
    if start < batch.num_rows:
        yield batch.slice(start)


def _mapped(df: DataFrame, column: str, to: str, keep: bool, codec_args: tuple, method: str) -> DataFrame:
    """``df`` with a binary column ``to`` (replaced if there) made of ``column`` by a method of the codec."""
    kept = [c for c in df.columns if c != to and (keep or c != column)]
    index = kept.index(column) if column in kept else len(kept)
    width = len(kept)
    rank_file, pattern = codec_args

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = getattr(_codec(rank_file.value, pattern), method)
        for batch in batches:
            for part in _parts(batch, index):
                made = of(part.column(index).to_pylist())
                yield pa.RecordBatch.from_arrays(part.columns[:width] + [pa.array(made, pa.binary())], [*kept, to])

    source = df.select(*kept) if index < width else df.select(*kept, F.col(column).alias("__in"))
    schema = df.select(*kept).withColumn(to, F.lit(b"")).schema
    return small_batches(source).mapInArrow(rows, schema)


def _args(spark: SparkSession, vocabulary: str, pattern: str) -> tuple:
    with open(vocabulary, "rb") as f:  # a vocabulary has a fixed size, below a few MB
        return spark.sparkContext.broadcast(f.read()), pattern


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", to: str = "ids", keep: bool = True) -> DataFrame:
    """``df`` with the ids of ``text`` in the binary column ``to``, four little-endian bytes an id.

    No special tokens. A null or empty text has no ids. A column ``to`` that is
    there already is replaced; others (but ``text`` itself if not ``keep``), repeated
    rows and row order within a partition are kept.
    """
    return _mapped(df, text, to, keep, _args(df.sparkSession, vocabulary, pattern), "encode_many")


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", to: str = "decoded", keep: bool = True) -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for in the binary column ``to``; null ids give no bytes."""
    return _mapped(df, ids, to, keep, _args(df.sparkSession, vocabulary, pattern), "decode_many")


def n_tokens(ids: str = "ids"):
    """The number of ids in a binary column of them."""
    return (F.octet_length(ids) / 4).cast("long")


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``ids``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (replaced if there).

    Encodes and decodes in one pass: the ids go back to bytes where they were
    made, so only digests of those leave the worker. Rows are as for :func:`encode`.
    """
    added = ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in df.columns if c != text and c not in added]
    rank_file, pattern = _args(df.sparkSession, vocabulary, pattern)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(rank_file.value, pattern)
        for batch in batches:
            for part in _parts(batch, len(kept)):
                made = codec.encode_many(part.column(len(kept)).to_pylist())
                more = [
                    pa.array(made, pa.binary()),
                    pa.array([len(x) // 4 for x in made], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in made], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *more], [*kept, *added])

    new = {"ids": F.lit(b""), "n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}
    schema = df.select(*kept).withColumns(new).schema
    return small_batches(df.select(*kept, F.col(text).alias("__text"))).mapInArrow(rows, schema)
