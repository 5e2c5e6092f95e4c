"""The manifest against trees built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from wayline.llm import manifest
from wayline.llm.queries import op13_merkle_manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, altered=False):
    d, source, lang, n, text = row
    text = text.replace("\n", "") if altered and text is not None else text
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)])


def climb(nodes, fanout):
    """The top, and for each node its siblings level by level with its place among them."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = nodes[at[k] // fanout * fanout :][:fanout]
            path.append((run, at[k] % fanout))
        at = [a // fanout for a in at]
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout=3):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        group = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (group, *climb([leaf_of(r) for r in group], fanout))
    root, over = climb([trees[s][1] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for row, path in zip(trees[s][0], trees[s][2]):
            steps = path + over[k]
            proof = sha(*["".join(x for i, x in enumerate(run) if i != at) for run, at in steps])
            altered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = leaf_of(row, altered)
            for run, at in steps:
                folded = sha(*run[:at], folded, *run[at + 1 :])
            out.append((str(row[0]), leaf_of(row), trees[s][1], root, proof, folded, folded == root))
    return sorted(out)


def docs_of(rng, n, names):
    text = lambda: rng.choice([None, "", "a\nb", "é\n\n", "plain", "x" * rng.randrange(50)])
    return [(d, rng.choice(names), rng.choice(["en", None]), rng.choice([1, None]), text()) for d in range(n)]


@pytest.mark.parametrize("n,names", [(120, ["a", "b", None, "é", "", "Z"]), (100, ["hot"] * 20 + ["s1", "s2"]), (1, ["only"]), (7, list("abcdefg"))])
def test_query_matches_brute_force(spark, tmp_path, n, names):
    rows = docs_of(random.Random(n), n, names)
    if n == 120:  # repeated ids and rows, an id that is null
        rows += [rows[0], rows[0], (rows[1][0], *rows[2][1:]), (None, "a", None, None, "x\ny"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumn("leaf", F.lit(1)).withColumn("idx", F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r[0]), *r[1:]) for r in op13_merkle_manifest(spark, str(tmp_path)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("fanout", [2, 5])
def test_every_row_folds_to_the_root(spark, fanout):
    rows = docs_of(random.Random(fanout), 60, ["a", "a", "a", "b", None])
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest.manifest(df, fanout=fanout, keep=[F.lit(1).alias("leaf2")])
    assert got.columns == ["doc_id", "leaf2", "leaf", "subroot", "root", "proof"]
    found = got.withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof"))).collect()
    assert len(found) == 60 and {r.root for r in found} == {brute(rows, fanout)[0][3]} == {r.folded for r in found}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest.manifest(df).collect() == []
