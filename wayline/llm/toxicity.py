"""Toxicity by a weighted lexicon.

Texts and lexicon entries are folded alike: lower case, lookalike letters of
other scripts and digits or signs that stand for letters replaced, invisible
characters gone, ``i`` and ``l`` made one. An Aho-Corasick automaton finds the
entries, whole words or word beginnings, in one pass over a text; matches inside
an exception phrase don't count. The sum of their weights over the text's length
becomes a probability by a logistic curve.

Weights are log odds learned from labelled documents by grouped counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.batches import small_batches
from wayline.llm.filters import may_hold
from wayline.storage import discard, materialize

# Lookalike letters, and what they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
# Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
# Invisible characters.
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a word of the lexicon is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "sore loser", "idiot proof")

_WIDE = {0xFF41 + k: chr(97 + k) for k in range(26)}
_LETTERS = {ord(k): v for k, v in LOOKALIKES.items()} | _WIDE
_ODD = re.compile("[" + "".join(map(chr, _LETTERS)) + "]")
_BESIDE = re.compile("[a-z]" + _ODD.pattern + "|" + _ODD.pattern + "[a-z]")
_RUN, _WIDE_RUN = re.compile(r"\w+"), re.compile("[ａ-ｚ]+")
_HIDDEN = re.compile(f"[{INVISIBLE}]+")
_CODED = re.compile(r"[0134578@$!|]+")
_STANDS_FOR = DIGITS | SIGNS
_WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7)
_FLUSH = 300_000


def _latin(run: re.Match) -> str:
    """A run of word characters in which a lookalike stands beside a Latin letter, in Latin; of others the wide letters alone."""
    word = run.group()
    if _BESIDE.search(word):
        return word.translate(_LETTERS)
    return _WIDE_RUN.sub(lambda m: m.group().translate(_WIDE), word)


def _decoded(run: re.Match) -> str:
    """A run of digits and signs before a letter as letters; a sign counts after a letter or digit only."""
    text, end = run.string, run.end()
    if not (end < len(text) and "a" <= text[end] <= "z"):
        return run.group()
    last, out = text[run.start() - 1] if run.start() else "", []
    for c in run.group():
        out.append(_STANDS_FOR[c] if c in DIGITS or "a" <= last <= "z" or last in DIGITS else c)
        last = c
    return "".join(out)


def fold(text: str | None) -> str:
    """The form in which texts and entries meet; empty for null."""
    t = (text or "").lower()
    if not t.isascii():
        t = _HIDDEN.sub("", t)
        if _ODD.search(t):
            t = _RUN.sub(_latin, t)
    t = _CODED.sub(_decoded, t)
    return t.replace("i", "l")


#: Entries of one automaton: some 100 MB in a worker. A larger lexicon is matched in several passes.
PART = 200_000


@dataclass
class Lexicon:
    """Entries with weights, exception phrases and the curve that turns a rate into a probability.

    More than PART learned entries stay in ``table`` (``entry, whole, weight,
    part``), from which they are taken part by part.
    """

    words: dict[str, float] = field(default_factory=dict)  # folded whole words
    beginnings: dict[str, float] = field(default_factory=dict)  # folded beginnings of words
    exceptions: tuple[str, ...] = EXCEPTIONS
    intercept: float = -3.0
    slope: float = 1.0
    table: DataFrame | None = None
    n_parts: int = 1

    def parts(self) -> Iterator[Lexicon]:
        """Lexicons of at most about PART entries, which together have all."""
        if self.table is None:
            yield self
            return
        for k in range(self.n_parts):
            yield _of_rows(self.table.where(F.col("part") == k).collect(), self.exceptions)

    def automaton(self) -> ahocorasick.Automaton | None:
        found: dict[str, list] = {}
        for i, (some, whole) in enumerate(((self.words, True), (self.beginnings, False))):
            for entry, weight in some.items():
                found.setdefault(entry, [len(entry), 0.0, 0.0, False])[1 + i] = weight
        for phrase in self.exceptions:
            phrase = fold(phrase)
            found.setdefault(phrase, [len(phrase), 0.0, 0.0, False])[3] = True
        if not found:
            return None
        out = ahocorasick.Automaton()
        for entry, what in found.items():
            out.add_word(entry, tuple(what))
        out.make_automaton()
        return out


def _of_rows(rows: list, exceptions: tuple[str, ...]) -> Lexicon:
    return Lexicon({r.entry: r.weight for r in rows if r.whole}, {r.entry: r.weight for r in rows if not r.whole}, exceptions)


def _matches(t: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, float]]:
    """Place and weight of the heaviest entry that begins at each place of a folded text, exceptions left out."""
    if automaton is None or not t:
        return []
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    size = len(t)
    for last, (length, word, beginning, exception) in automaton.iter(t):
        start = last + 1 - length
        if start and t[start - 1].isalnum():
            continue
        closed = last + 1 == size or not t[last + 1].isalnum()
        if exception and closed:
            spared.append((start, last))
        weight = max(beginning, word if closed else 0.0)
        if weight > best.get(start, 0.0):
            best[start] = weight
    found = sorted(best.items())
    if not spared:
        return found
    spared.sort()
    kept, k, reach = [], 0, -1  # one pass over both in order of place
    for start, weight in found:
        while k < len(spared) and spared[k][0] <= start:
            reach = max(reach, spared[k][1])
            k += 1
        if start > reach:
            kept.append((start, weight))
    return kept


def weigh(text: str | None, automaton: ahocorasick.Automaton | None) -> tuple[float, int, int]:
    """Weights found in a text, matches, words. Of entries that begin at one place the heaviest counts."""
    t = fold(text)
    found = _matches(t, automaton)
    return sum(w for _, w in found), len(found), len(t.split())


def _rate(total: Column, n_words: Column) -> Column:
    """Weight for each word, smoothed for short texts, on a logarithmic scale."""
    return F.log1p(F.lit(100.0) * total / (n_words + F.lit(20.0)))


_ADDED = ("__weight", "__matches", "__words")


def weighed(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``__weight, __matches, __words`` added.

    A lexicon of several parts takes a pass for each: what was found so far goes
    along with a row, and the heaviest match at each place stays.
    """
    kept = [c for c in docs.columns if c != text]
    context = docs.sparkSession.sparkContext
    if lexicon.table is not None:
        return _in_passes(docs, lexicon, text, kept)
    shared = context.broadcast(lexicon)  # at most PART entries, if learned

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            got = [weigh(t.as_py(), automaton) for t in batch.column(len(kept))]
            new = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(kept)] + new, [*kept, *_ADDED])

    types = ("double", "bigint", "bigint")
    schema = docs.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in zip(_ADDED, types)]).schema
    return small_batches(docs.select(*kept, F.col(text).alias("__text"))).mapInArrow(rows, schema)


def _in_passes(docs: DataFrame, lexicon: Lexicon, text: str, kept: list[str]) -> DataFrame:
    n = len(kept)
    none = F.lit(None).cast("array<struct<at:int,weight:double>>")
    state = docs.select(*kept, F.col(text).alias("__text"), none.alias("__found"), F.lit(0).cast("bigint").alias("__words"))
    schema, kind = state.schema, pa.list_(pa.struct([("at", pa.int32()), ("weight", pa.float64())]))
    before = None
    for part in lexicon.parts():
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value.automaton()
            for batch in batches:
                found, words = [], []
                for t, old in zip(batch.column(n), batch.column(n + 1)):
                    folded = fold(t.as_py())
                    best = {x["at"]: x["weight"] for x in old.as_py() or ()}
                    for at, weight in _matches(folded, automaton):
                        best[at] = max(weight, best.get(at, 0.0))
                    found.append([{"at": at, "weight": w} for at, w in sorted(best.items())])
                    words.append(len(folded.split()))
                arrays = [*batch.columns[: n + 1], pa.array(found, kind), pa.array(words, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, "__text", "__found", "__words"])

        state = materialize(small_batches(state).mapInArrow(rows, schema), "matched")
        if before is not None:
            discard(before)
        before = state
    total = F.aggregate("__found", F.lit(0.0), lambda a, x: a + x["weight"])
    return state.select(*kept, total.alias("__weight"), F.size("__found").cast("long").alias("__matches"), "__words")


def _counted(labelled: DataFrame) -> DataFrame:
    """``entry, whole, toxic, clean``: documents of each class that hold a word or a word's beginning."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool], list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            arrays = [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.bool_()),
                pa.array([counts[k][1] for k in keys], pa.int64()),
                pa.array([counts[k][0] for k in keys], pa.int64()),
            ]
            counts.clear()
            return pa.RecordBatch.from_arrays(arrays, ["entry", "whole", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(_WORD.findall(fold(text.as_py())))
                entries = {(w, True) for w in words if len(w) > 2}
                entries |= {(w[:k], False) for w in words for k in PREFIXES if len(w) >= k}
                for e in entries:
                    counts.setdefault(e, [0, 0])[toxic] += 1
                if len(counts) >= _FLUSH:
                    yield flush()
        yield flush()

    return small_batches(labelled.select("text", "toxic")).mapInArrow(rows, "entry string, whole boolean, toxic bigint, clean bigint")


def _curve(x: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through grouped counts: ``y`` of ``n`` at ``x``; Newton's method."""
    w = np.array([math.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5)), 0.0])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - n * p) - np.array([1e-3, ridge]) * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, ridge])
        step = np.clip(np.linalg.solve(hess, grad), -3, 3)
        w += step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def learn(
    labelled: DataFrame,
    text: str = "text",
    toxic: str = "toxic",
    min_docs: int = 3,
    min_precision: float = 0.9,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """A lexicon from labelled texts; rows with a null label are left out.

    An entry is taken if at least ``min_docs`` toxic documents hold it, of all that
    hold it at least ``min_precision`` are toxic, and its share of toxic documents
    is further above the general one than chance explains among all entries (a
    Chernoff bound, divided by the number of entries); all that pass are taken.
    Repeated rows are separate documents. Without toxic or without clean rows the
    lexicon is empty and its curve gives the general share. ``labelled`` is read
    three times.
    """
    rows = labelled.where(F.col(toxic).isNotNull()).select(F.col(text).alias("text"), (F.col(toxic) != 0).cast("int").alias("toxic"))
    n_toxic, n_all = rows.agg(F.sum("toxic"), F.count("*")).first()
    n_toxic, n_clean = n_toxic or 0, n_all - (n_toxic or 0)
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    if not n_toxic or not n_clean:
        return Lexicon(exceptions=exceptions, intercept=prior)
    counts = _counted(rows).groupBy("entry", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialize(counts.where(F.col("toxic") >= min_docs), "entries")
    tested = max(1, counts.count())
    share, base, n = F.col("toxic") / (F.col("toxic") + F.col("clean")), n_toxic / n_all, F.col("toxic") + F.col("clean")
    apart = share * F.log(share / F.lit(base)) + F.when(share < 1, (1 - share) * F.log((1 - share) / F.lit(1 - base))).otherwise(0.0)
    chosen = (
        counts.withColumn("evidence", n * apart)
        .where((share >= max(base, min_precision)) & (F.col("evidence") >= math.log(10.0 * tested)))
        .withColumn("weight", F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0)))
        .where("weight > 0")
        .select("entry", "whole", "weight")
    )
    chosen = materialize(chosen, "lexicon")
    n_chosen = chosen.count()
    if n_chosen <= PART:
        lexicon = _of_rows(chosen.collect(), exceptions)
    else:
        n_parts = -(-n_chosen // PART)
        lexicon = Lexicon(exceptions=exceptions, table=chosen.withColumn("part", F.pmod(F.xxhash64("entry"), F.lit(n_parts))), n_parts=n_parts)
    at = weighed(rows, lexicon).groupBy(F.round(_rate(F.col("__weight"), F.col("__words")), 2).alias("x"))
    bins = at.agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).collect()  # as many as there are rounded rates, below 2000
    x, n, y = (np.array([float(r[k]) for r in bins]) for k in range(3))
    lexicon.intercept, lexicon.slope = _curve(x, n, y)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``score`` (0 to 1), ``n_matches`` and ``n_words``; columns of these names are replaced.

    Null and empty texts have no matches, so they get the curve's least value.
    Whole texts are read; rows are kept as they are, repeated ones too.
    """
    docs = docs.drop("score", "n_matches", "n_words")
    curve = F.lit(1.0) / (1.0 + F.exp(-(F.lit(lexicon.intercept) + F.lit(lexicon.slope) * _rate(F.col("__weight"), F.col("__words")))))
    kept = [c for c in docs.columns if c != text]
    return weighed(docs, lexicon, text).select(*kept, curve.alias("score"), F.col("__matches").alias("n_matches"), F.col("__words").alias("n_words"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is never learned from: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def join_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``text, toxic`` of the labelled documents that may be learned from.

    Labels that repeat count once, the toxic one wins; null ids and labels drop
    out, rows of ``docs`` that repeat stay. Joined by shuffle at every size; texts
    without a label are mostly left out before it.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    known = materialize(known.groupBy(id_col).agg(F.max(label).alias("toxic")), "labels")
    n_known = known.count()
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, "text")
    return may_hold(rows, known, [id_col], n_known).join(known.hint("merge"), id_col).select("text", "toxic")
