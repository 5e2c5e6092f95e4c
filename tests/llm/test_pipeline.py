"""The pipeline against its stages done one by one by brute force."""

import hashlib

import corpus_pipeline
import numpy as np
import test_decontaminate
import test_line_dedup
import test_simhash
from test_byte_bpe import REFERENCE
from wayline.llm import decontaminate


def brute(docs, items, accepted):
    rows = [(d, t) for d, t in docs if d in accepted]
    rows = [(int(d), t) for d, t, _, _ in test_line_dedup.brute(rows)]
    kept = {int(d) for d, _, c in test_simhash.brute(rows) if int(d) == c}
    rows = [(d, t) for d, t in rows if d in kept]
    items = [w for _, t in items if (w := test_decontaminate.words(t))]
    leaks = {d for d, t in rows if any(decontaminate.align(w, test_decontaminate.words(t))[0] >= decontaminate.THRESHOLD * 2 * len(w) for w in items)}
    out = {}
    for d, t in rows:
        if d not in leaks:
            ids = np.array(REFERENCE.encode_ordinary(t), "<u4").tobytes()
            out[d] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_run_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    accepted = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect()}
    assert len(accepted) > 190
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items, accepted)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and len(got) < len(accepted)


def test_odd_rows_pass_all_stages(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "the " * 40, "en", "src0", 5), (10**6, "", None, "src0", 0), (10**6, "", None, "src0", 0), (10**6 + 1, "of the and to in is " * 20000, "en", None, 1)]
    docs = base.limit(50).unionByName(spark.createDataFrame(odd, base.schema))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert name == "byte_bpe" or docs.columns == corpus_pipeline.COLUMNS
    ids = [r.doc_id for r in docs.collect()]
    assert 10**6 + 1 in ids and ids.count(10**6) <= 1 and len(ids) > 30
    empty = base.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_near_dedup_judges_each_text_of_a_repeated_id(spark):
    one, other = " ".join(f"one{k}" for k in range(60)), " ".join(f"other{k}" for k in range(60))
    rows = [(1, one), (2, one), (2, other), (3, other + " end"), (None, one)]
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert {(1, one), (2, other), (None, one)} <= got and (2, one) not in got


def test_near_dedup_keeps_texts_that_no_other_row_has(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in [(3, b), (5, a), (5, b), (7, c)]], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {(3, b), (5, a), (7, c)}
