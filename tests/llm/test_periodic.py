"""Runs against a search of every period, the query against its contract row by row."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

from pyspark.sql import functions as F
from wayline.llm import periodic
from wayline.llm.queries import op11_periodic_runs


def brute(words):
    """For every period, the maximal stretches in which words a period apart are equal."""
    best = {}
    for p in range(1, len(words) // 3 + 1):
        start = None
        for i in range(len(words) - p + 1):
            if i < len(words) - p and words[i] == words[i + p]:
                start = i if start is None else start
            elif start is not None:
                if i + p - start >= max(24, 3 * p):
                    best.setdefault((start, i + p), p)
                start = None
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


def random_words(rng):
    n, v = rng.choice([0, 1, 5, 23, 24, 30, 60, 150]), rng.choice([1, 2, 2, 3, 30])
    words = [str(rng.randrange(v)) for _ in range(n)]
    if rng.random() < 0.6 and n > 30:
        a, p = rng.randrange(n // 2), rng.randint(1, 12)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_match_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        texts = [[w.encode() for w in random_words(rng)] for _ in range(rng.randint(1, 6))]
        found = periodic.find_runs(texts)
        assert found == [brute(t) for t in texts]
        assert [periodic.collapse(t, r) for t, r in zip(texts, found)] == [b" ".join(kept(t, r)) for t, r in zip(texts, found)]


def test_long_texts_are_done_in_time():
    began = time.perf_counter()
    assert periodic.find_runs([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    fibonacci = [b"a", b"ab"]
    while len(fibonacci[-1]) < 100_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periodic.find_runs([[bytes([c]) for c in fibonacci[-1]]])[0]
    assert time.perf_counter() - began < 30


def test_odd_rows_and_columns(spark):
    rows = [(1, None, 7), (1, "", 7), (None, " \n\t", 8), (2, "x " * 24, None), (2, "x " * 24, None), (3, "x " * 23, 9), (4, "é é " * 30, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs int")
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect())
    assert got == sorted([
        ("1", [], ""), ("1", [], ""), ("None", [], ""), ("2", [(0, 24, 1)], "x"), ("2", [(0, 24, 1)], "x"),
        ("3", [], " ".join(["x"] * 23)), ("4", [(0, 30, 1)], "é é"),
    ])
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query_matches_its_contract(spark, tmp_path):
    rng, rows = random.Random(5), []
    for d in range(400):
        rows.append((d, "\n ".join(random_words(rng)) + rng.choice(["", " ", "\t"])))
    rows += [(1000, None), (None, "a b c"), (10, " ".join(["q"] * 40))]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        s, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((
            str(d), len(runs), s, length, period, 1000 * length // period if runs else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(kept(words, runs))),
        ))
    got = [(str(r[0]), *r[1:]) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[1] for r in want)
