import numpy as np

from wayline.operators import sequence, tracking


def test_many_short_series_take_one_round(spark, monkeypatch):
    """Series of few rows that lie far apart in the order are not cut, and many of them are one task's."""
    rng = np.random.default_rng(2)
    rows = [(f"c{k % 150}", k * 40, *(None if rng.random() < 0.2 else float(v) for v in rng.uniform(0, 9000, 2))) for k in range(3000)]
    want = {}
    for cell in {r[0] for r in rows}:
        last = None
        for _, i, x, y in (r for r in rows if r[0] == cell):
            ok = x is not None and y is not None and (last is None or (x - last[1]) ** 2 + (y - last[2]) ** 2 <= (i - last[0]) ** 2)
            last = (i, x, y) if ok else last
            want[cell, i] = ok
    written = []
    before = sequence.materialize

    def materialize(df, name):
        written.append(name)
        return before(df, name)

    monkeypatch.setattr(sequence, "materialize", materialize)
    df = spark.createDataFrame(rows, "cell string, i long, x double, y double").repartition(3)
    got = {(r.cell, r.i): r.ok for r in tracking.jump_filter(df, 1.0, ("cell",), 1000, 10).collect()}
    assert got == want and 0.1 < np.mean(list(want.values())) < 0.9
    assert written.count("scanned") == 1


def test_short_and_long_series_together(spark):
    """The long ones are cut and the short ones not; a run backwards too."""

    def step(rows, state):
        total, out = 0.0 if state is None else float(state[0]), []
        for v in rows["v"].tolist():
            total = v if v > 5 else total + v  # forgets at a large value
            out.append(total)
        return {"s": out}, np.array([total])

    rng = np.random.default_rng(3)
    sizes = {"a": 900, "b": 30, "c": 1, "d": 130, "e": 100}
    rows = [(k, i, float(v)) for k, n in sizes.items() for i, v in enumerate(rng.uniform(0, 6, n))]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(3)
    for ahead in (False, True):
        want = {}
        for k in sizes:
            total = 0.0
            for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1] if ahead else r[1]):
                total = v if v > 5 else total + v
                want[k, i] = total
        got = sequence.scan_chunks(df, ("k",), "i", step, {"s": "double"}, 100, 3, ahead).collect()
        assert {(r.k, r.i): r.s for r in got} == want
