"""Draws and orders of replicates against the slow way, row by row."""

import hashlib

import numpy as np
import pandas as pd

from wayline.functions.md5 import first_bits
from wayline.operators import resampling


made_before = resampling.materialize


def drawn(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def table(spark, n=700, seed=1, slope=0.05):
    rng = np.random.default_rng(seed)
    x = rng.exponential(10, n)
    df = pd.DataFrame({"i": np.arange(n), "x": x, "y": slope * x + rng.normal(0, 1, n)})
    return df, spark.createDataFrame(df).repartition(3)


def test_first_bits_are_those_of_the_library():
    numbers = [0, 7, 10, 99, 100, 54321, 10**9 - 1, 10**9, 2**32, 10**18, 2**63 - 1, -5, *range(9990, 10010)]
    for head in ("", "0:1:", "0:12:", "3:1000:", "0:7:19:"):
        assert first_bits(head, np.array(numbers)).tolist() == [drawn(f"{head}{k}") for k in numbers]


def test_permutations_in_parts(spark, monkeypatch):
    """Orders made in several parts, as of tables that one task doesn't hold."""
    df, rows = table(spark)
    for most in (1 << 22, 100):
        monkeypatch.setattr(resampling, "_SORTED", most)
        got = {r.rep: r.r for r in resampling.permuted(rows, 4).collect()}
        for rep in range(1, 5):
            order = sorted(range(len(df)), key=lambda i: drawn(f"0:{rep}:{i}"))
            assert np.isclose(got[rep], np.corrcoef(df.x, df.y[order])[0, 1], atol=1e-12)


def test_sign_bootstrap_in_ranges(spark, monkeypatch):
    df, rows = table(spark, 40, 3, 0.0)
    draws = [[drawn(f"0:{rep}:{i}") % 40 for i in range(40)] for rep in range(1, 61)]
    own = np.corrcoef(df.x, df.y)[0, 1]
    want = np.mean([np.sign(np.cov(df.x[d], df.y[d])[0, 1]) != np.sign(own) for d in draws])
    assert 0 < want < 1
    for most in (1 << 26, 13):
        monkeypatch.setattr(resampling, "_SLOTS", most)
        got = resampling.sign_bootstrap(rows, 60).first()
        assert np.isclose(got.r, own) and np.isclose(got.p, want)


def test_no_row_for_each_draw_in_the_plan(spark, monkeypatch):
    """What is joined, shuffled or sent to the driver doesn't grow with draws: rows times replicates."""
    df, rows = table(spark)
    kept = []
    monkeypatch.setattr(resampling, "materialize", lambda made, name: kept.append(made) or made_before(made, name))
    for got in (resampling.binned_bootstrap(rows, 30), resampling.sign_bootstrap(rows, 30), resampling.permutation_test(rows, 30)):
        assert got.first().r is not None
    assert len(kept) == 6 and max(t.count() for t in kept) <= len(df)

