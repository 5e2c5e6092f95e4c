"""Each query that has an oracle gives the oracle's rows."""

import duckdb
import pytest
from wayline.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in cur.description)
    order = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted(tuple(row[i] for i in order) for row in cur.fetchall())
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert got == want
