"""Components against all pairs of full sets; the sketch against what it estimates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from wayline.llm import setsketch
from wayline.llm.queries import op12_setsketch_near_dedup

BLANKS = " \t\n\x0b\x0c\r"


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANKS:
        lowered = lowered.replace(b, " ")
    words = [w for w in lowered.split(" ") if w]
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for j, s in enumerate(sets):
        for i in {i for x in s for i in holders[x] if i < j}:
            common = len(sets[i] & s)
            if 100 * common >= 80 * (len(sets[i]) + len(s) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d), d is not None and (d == least.get(find(i)) or not sets[i])) for i, (d, _) in enumerate(rows))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def got(df):
    return sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in df.collect())


def test_matches_all_pairs(spark):
    rng, texts = random.Random(12), []
    for n, edits, copies in [(200, 4, 30), (60, 1, 25), (100, 3, 60), (400, 9, 20), (12, 1, 6), (30, 1, 20)]:
        base = [f"w{rng.randrange(1000)}" for _ in range(n)]
        texts += [" ".join(edited(rng, base, rng.randrange(edits + 1))) for _ in range(copies)]
        chain = base
        for _ in range(10):  # each a copy of the one before
            chain = edited(rng, chain, max(1, edits // 2))
            texts.append("\n".join(chain).upper())
    texts += ["a b c", "A  B\tC", "a b c d", "a b c d e", "x", "X ", "", None, "é É", "É é", texts[0], texts[0]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(3, rows[3][1]), (3, "of another text altogether it seems"), (None, rows[5][1]), (None, "alone and without an id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit(1)).withColumn("root", F.lit("x")).repartition(5)
    want = brute(rows)
    assert got(setsketch.near_duplicates(df)) == want
    assert len({w[2] for w in want}) < len(rows) / 2


def test_last_comparison_is_of_what_is_open(spark, monkeypatch):
    """Texts that are nearly alike without a likely partner, or with one alone, don't come to the comparison of all with all."""
    rng, met = random.Random(21), []
    base = [f"w{rng.randrange(1000)}" for _ in range(200)]
    texts = [" ".join(edited(rng, base, rng.randrange(10, 22))) for _ in range(250)]
    texts += [" ".join(edited(rng, t.split(" "), rng.randrange(1, 8))) for t in texts[:60] for _ in range(2)]
    rows = list(enumerate(texts))
    likely = setsketch._likely

    def counted(held, passing, *how):
        met.append((held.count(), passing.count()))
        return likely(held, passing, *how)

    monkeypatch.setattr(setsketch, "_likely", counted)
    assert got(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)
    assert len(met) < 3 or met[2][0] < met[1][0] / 3 and met[2][1] < met[1][1], met


def test_classes_that_share_many_buckets_meet_once(spark, monkeypatch):
    """A class is no more rows of the later comparison than it has hubs, however many buckets it shares."""
    rng, met = random.Random(23), []
    base = [f"w{rng.randrange(1000)}" for _ in range(200)]
    texts = [" ".join(edited(rng, base, rng.randrange(8, 14))) for _ in range(150)]
    rows = list(enumerate([*texts, " ".join(base)]))
    likely = setsketch._likely

    def counted(held, passing, *how):
        met.append(passing.count())
        return likely(held, passing, *how)

    monkeypatch.setattr(setsketch, "_likely", counted)
    assert got(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)
    assert len(met) > 1 and met[1] <= met[0], met


def test_hubs_of_the_same_classes_are_one_group(spark, monkeypatch):
    """What is alike in great numbers has many hubs, but a class is few rows of the first comparison."""
    rng, met = random.Random(29), []
    base = [f"w{rng.randrange(1000)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, min(12, int(rng.expovariate(0.25)))))) for i in range(400)]
    likely = setsketch._likely

    def counted(held, passing, *how):
        met.append(passing.count())
        return likely(held, passing, *how)

    monkeypatch.setattr(setsketch, "_likely", counted)
    assert got(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)
    assert met[0] < 2 * len(rows), met


def test_far_copies_of_one_text_are_no_pairs(spark, monkeypatch):
    """The last comparison gives few pairs of what is nearly alike but not linked, though each such text resembles many others."""
    rng, found = random.Random(31), []
    base = [f"w{rng.randrange(1000)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, min(12, int(rng.expovariate(0.25)))))) for i in range(500)]
    likely = setsketch._likely

    def counted(*how):
        found.append(likely(*how))
        return found[-1]

    monkeypatch.setattr(setsketch, "_likely", counted)
    monkeypatch.setattr(setsketch, "discard", lambda df: None)
    assert got(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)
    assert len(found) < 3 or found[2].count() < len(rows) / 4, [x.count() for x in found]


def test_query_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_setsketch_near_dedup(spark, sf_dir)) == brute(rows)


def test_empty_and_unlinked_tables(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert setsketch.near_duplicates(empty).collect() == []
    rows = [(1, "one two three four five"), (2, None), (3, " \n")]
    assert got(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"))) == brute(rows)


@pytest.mark.parametrize("n,share", [(50, 0.9), (500, 0.8), (5000, 0.5), (300, 0.95)])
def test_registers_estimate_the_similarity(n, share):
    rng, seen = np.random.default_rng(n), []
    for _ in range(40):
        common = rng.integers(0, 1 << 63, round(n * share), np.uint64)
        own = [rng.integers(0, 1 << 63, n - len(common), np.uint64) for _ in range(2)]
        a, b = (setsketch.registers(np.concatenate([common, x])) for x in own)
        seen.append(setsketch.likeliest(a[None], b[None], np.array([float(n)]), np.array([float(n)]))[0])
    j = len(common) / (2 * n - len(common))
    assert abs(np.mean(seen) - j) < 0.02 and np.std(seen) < 0.05
    both = setsketch.registers(np.concatenate([common, *own]))
    assert (both == np.maximum(a, b)).all()  # registers of a union


def test_registers_of_very_large_sets_stay_on_the_grid():
    r = setsketch.registers(np.random.default_rng(0).integers(0, 1 << 63, 300_000, np.uint64))
    assert r.max() < 255 and r.min() > 0
