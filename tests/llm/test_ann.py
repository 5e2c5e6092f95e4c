import math

import numpy as np
from wayline.llm import ann


def brute(rows, every=20, k=20):
    out = []
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def check(got, want, least):
    a = {(r.query_id, r.vec_id): r.score for r in got}
    b = {(q, i): s for q, _, i, s in want}
    assert len(a) == len(b) == len(got)
    assert sum(x in b for x in a) >= least * len(b)
    for x in a:
        if x in b:
            assert math.isclose(a[x], b[x], rel_tol=1e-12, abs_tol=1e-15)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    for some in by.values():
        assert [r.rank for r in some] == list(range(1, len(some) + 1))
        assert all((-x.score, x.vec_id) < (-y.score, y.vec_id) for x, y in zip(some, some[1:]))


def test_recall_norms_and_groups_of_copies(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 16)) * rng.uniform(0.2, 2, (1500, 1))
    v[200:700] = v[200]  # a third are copies
    rows = [(int(i), [float(x) for x in np.float32(w)]) for i, w in enumerate(v)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [1.0]), (None, [1.0] * 16), (5100, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, "c") for r in rows + odd + rows[:40]], "vec_id long, embedding array<float>, score string")
    check(ann.nearest(df, leaf=100).collect(), brute(rows), 0.9)


def test_few_candidates_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (7, [0.0, 1.0])]
    check(ann.nearest(spark.createDataFrame(rows, schema)).collect(), brute(rows), 1.0)
    assert ann.nearest(spark.createDataFrame(rows[:1], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0


def test_recall_of_the_query(spark):
    from wayline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op5_nearest_neighbours"](spark, sf).collect(), brute(rows), 0.9)


def test_chi_square():
    assert abs(ann.chi_square_inverse(0.95, 10) - 18.307) < 1e-3


def test_ids_that_repeat_with_other_vectors(spark):
    big = (2**62 // 20) * 20
    rows = [(big, [1.0, 0.0]), (big, [0.0, 1.0]), (big + 1, [1.0, 0.1]), (big + 2, [0.1, 1.0]), (big + 2, [1.0, 1.0]), (big + 3, [1.0, 0.1])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).collect()
    assert sorted((r.rank, r.vec_id - big, round(r.score, 6)) for r in got) == [(1, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0), (2, 2, 1.0)]
    assert {r.query_id for r in got} == {big}
