"""Queries on events as no generated table has them, against their oracles."""

import duckdb
import pandas as pd

from wayline import index_queries
from wayline.queries import ORACLES


def events(tmp_path, **columns):
    """An events table at ``tmp_path``; columns that are not given are made up."""
    n = len(next(iter(columns.values())))
    made = {"event_id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(n), unit="s"), "user_id": 1, "event_type": "click", "value": 1.0, "props": '{"k": 1}'}
    rows = pd.DataFrame(made | columns)
    duckdb.sql("SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM rows").write_parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def oracle(sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    return con.execute(ORACLES[name]).df()


def test_stacked_histogram_has_bins_of_its_types_only(spark, tmp_path):
    """A bin that only other types reach has no row; what has no value is a bin of its own."""
    sf = events(tmp_path, event_type=["click", "view", "error", "click", "view", "view"], value=[10.0, 60.0, 260.0, None, None, 12.0])
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in index_queries.stacked_histogram(spark, sf).collect()), key=key)
    want = oracle(sf, "stacked_histogram").astype(object)
    want = sorted((tuple(None if v is pd.NA or v != v else int(v) for v in r) for r in want.itertuples(index=False)), key=key)
    assert got == want == [(0, 1, 1), (1, 0, 1), (None, 1, 1)]
