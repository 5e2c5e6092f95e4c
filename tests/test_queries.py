"""Each query that has an oracle gives the oracle's rows."""

import math

import duckdb
import pytest
from wayline import field_queries, index_queries, signal_queries  # noqa: F401
from wayline.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    columns = sorted(names)
    key = lambda row: tuple((x is None, x if x is not None else 0) for x in row)
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in cur.fetchall()), key=key)
    assert sorted(df.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert len(got) == len(want) and want
    assert all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y)), [(x, y) for x, y in zip(got, want) if not all(map(same, x, y))][:3]
