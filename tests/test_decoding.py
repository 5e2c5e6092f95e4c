import time

import numpy as np
from pyspark.sql import functions as F

from wayline.operators import decoding as D


def brute(ll, moves):
    """Causal and acausal posteriors of one session by sums over all of it."""
    n, s = ll.shape
    f = np.zeros((n, s))
    for t in range(n):
        prior = np.full(s, 1 / s) if t == 0 else f[t - 1] @ moves
        f[t] = prior * np.exp(ll[t])
        f[t] /= f[t].sum()
    b = np.ones((n, s))
    for t in range(n - 2, -1, -1):
        b[t] = moves @ (np.exp(ll[t + 1]) * b[t + 1])
        b[t] /= b[t].sum()
    both = f * b
    return f, both / both.sum(axis=1, keepdims=True)


def test_filter_and_smoother(spark):
    rng = np.random.default_rng(6)
    n_bins, names = 4, ["continuous", "fragmented", "stationary"]
    moves = np.array(D.event_states(n_bins, 2.0, 3.0))
    assert np.allclose(moves.sum(axis=1), 1)
    ll = {s: rng.normal(0, 2, (15, n_bins)) for s in (1, 2, 3)}
    rows = [(s, t, ll[s][t].tolist()) for s in ll for t in range(15)]
    df = spark.createDataFrame(rows, "session int, t long, l array<double>").repartition(3)
    causal = D.forward_filter(D.spread(df, 3), moves.tolist())
    smooth = D.backward_smoother(causal, moves.tolist())
    got_c = {(r.session, r.t): r.p for r in causal.collect()}
    got_s = {(r.session, r.t): r.p for r in smooth.collect()}
    states = {(r.session, r.t, r.state): r.p for r in D.marginals(smooth, names, n_bins).collect()}
    assert len(got_c) == len(got_s) == 45 and len(states) == 135
    for s in ll:
        f, b = brute(np.tile(ll[s], 3), moves)
        for t in range(15):
            assert np.allclose(got_c[s, t], f[t]) and np.allclose(got_s[s, t], b[t])
            assert np.isclose(states[s, t, "fragmented"], b[t, n_bins : 2 * n_bins].sum())


def test_moves_are_those_of_their_table():
    rng = np.random.default_rng(1)
    for n_bins, variance in ((1, 2.0), (7, 3.0), (40, 1e4), (90, 0.5)):
        table, moves = np.array(D.event_states(n_bins, 2.0, variance)), D.event_moves(n_bins, 2.0, variance)
        v = rng.random(3 * n_bins)
        assert np.allclose(moves.onward(v), table.T @ v, rtol=1e-12) and np.allclose(moves.back(v), table @ v, rtol=1e-12)


def test_chunks_start_from_what_they_forgot(spark):
    """Short overlaps, sticky moves, a gap in time: chunks run again until their starts are right."""
    rng = np.random.default_rng(9)
    moves = np.array([[0.999, 0.001], [0.002, 0.998]])
    times = [t for t in range(70) if not 20 <= t < 41]
    ll = rng.normal(0, 0.3, (len(times), 2))
    df = spark.createDataFrame([(1, t, ll[k].tolist()) for k, t in enumerate(times)], "session int, t long, l array<double>")
    f, b = brute(ll, moves)
    for chunk, overlap in ((8, 2), (5, 5), (100, 3), (1, 1)):
        causal = D.forward_filter(df, moves.tolist(), chunk=chunk, overlap=overlap)
        assert np.allclose([r.p for r in causal.orderBy("t").collect()], f, atol=1e-10)
        smooth = D.backward_smoother(causal, moves.tolist(), chunk=chunk, overlap=overlap)
        assert np.allclose([r.p for r in smooth.orderBy("t").collect()], b, atol=1e-10)


def test_many_states_in_a_long_series(spark):
    n_bins, n = 200, 20_000
    cols = [F.sin(F.col("id") / 50 + k / 30).alias(f"c{k}") for k in range(n_bins)]
    ll = spark.range(n).select(F.lit(1).alias("session"), F.col("id").alias("t"), F.array(*cols).alias("l"))
    began = time.perf_counter()
    rows = D.forward_filter(D.spread(ll, 3), D.event_moves(n_bins, 1.0, 9.0)).where(f"t >= {n - 5}").orderBy("t").collect()
    assert time.perf_counter() - began < 120
    x = np.sin(np.arange(n)[:, None] / 50 + np.arange(n_bins) / 30)
    table, p = np.array(D.event_states(n_bins, 1.0, 9.0)), None
    for t in range(n - 600, n):  # whatever came before is forgotten
        p = np.exp(np.tile(x[t], 3)) * (np.ones(600) if p is None else table.T @ p)
        p /= p.sum()
    assert len(rows) == 5 and np.allclose(rows[-1].p, p, atol=1e-10)


def test_classification_of_events(spark):
    rng, n_bins, dt = np.random.default_rng(4), 5, 0.5
    rates = {c: rng.uniform(0.1, 4, n_bins) for c in "abc"}
    fields = spark.createDataFrame([(c, g, float(r)) for c in rates for g, r in enumerate(rates[c])], "cell string, gx int, rate double")
    counts = {("e1", 2, "a"): 3, ("e1", 2, "b"): 1, ("e1", 4, "c"): 2, ("e2", 0, "a"): 1, ("e2", 0, "unknown"): 4}
    df = spark.createDataFrame([(*k, n) for k, n in counts.items()], "session string, t long, cell string, n int")
    spans = spark.createDataFrame([("e1", 6), ("e2", 1)], "session string, n_t int")
    got = {(r.session, r.t, r.state): r.p for r in D.classify(df, spans, fields, dt, n_bins, 1.0, 2.0).collect()}
    assert len(got) == 21
    for name, n_t in (("e1", 6), ("e2", 1)):
        ll = np.array([sum(counts.get((name, t, c), 0) * np.log(rates[c] * dt) - rates[c] * dt for c in rates) for t in range(n_t)])
        _, b = brute(np.tile(ll, 3), np.array(D.event_states(n_bins, 1.0, 2.0)))
        for t in range(n_t):
            for k, state in enumerate(D.MOVEMENTS):
                assert np.isclose(got[name, t, state], b[t, k * n_bins : (k + 1) * n_bins].sum())


def test_movement_variance(spark):
    x = np.random.default_rng(7).normal(0, 1, 300).cumsum()
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "trial int, i long, x double")
    assert np.isclose(D.movement_variance(df, "x", 50.0, ("trial",)).first().movement_var, np.var(np.diff(x), ddof=1) * 50)
