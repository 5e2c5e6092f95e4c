"""Run peaks against a loop over the runs."""

import random

import pytest
from wayline.operators import peaks


def brute(rates, labels, least, share, wing):
    n, out, i = len(rates), [], 0
    while i < n:
        j = i
        while j < n and labels[j] == labels[i]:
            j += 1
        if labels[i] and max(rates[i:j]) > least:
            size, top = j - i, max(rates[i:j])
            peak = rates.index(top, i)
            a = b = peak
            while a > i and rates[a - 1] >= share * top:
                a -= 1
            while b < j - 1 and rates[b + 1] >= share * top:
                b += 1
            good = True
            if a == i:
                below = [k for k in range(1, size + 1) if i - k >= 0 and rates[i - k] < share * top]
                good = bool(below) and below[0] - 1 < size * wing
                a = i - (below[0] - 1) if good else a
            if b == j - 1:
                below = [k for k in range(size) if j - 1 + k < n and rates[j - 1 + k] < share * top]
                good = good and bool(below) and below[0] < size * wing
                b = j - 1 + below[0] if good else b
            if good:
                out.append((labels[i], i, j - 1, peak, top, a, b))
        i = j
    return [(k + 1, *x) for k, x in enumerate(out)]


@pytest.mark.parametrize("share,wing", [(0.5, 0.2), (0.7, 0.9), (0.3, 0.5)])
def test_run_peaks_match_a_loop(spark, share, wing):
    rng, rates, labels = random.Random(7), [], []
    x = 5.0
    while len(rates) < 3000:
        label = rng.choice([0, 1, 2, 3])
        for _ in range(rng.choice([1, 3, 20, 60, 400])):
            x = max(0.0, x + rng.gauss(0, 1) * rng.choice([0.3, 1]) - 0.02 * (x - 4))
            rates.append(round(x, 1))
            labels.append(label)
    df = spark.createDataFrame([(k, r, lab) for k, (r, lab) in enumerate(zip(rates, labels))], "i long, rate double, label int").repartition(5)
    got = peaks.find_run_peaks(df, least=2.0, share=share, wing=wing)
    found = sorted(tuple(r) for r in got.select("run", "label", "first", "last", "i", "rate", "start", "end").collect())
    want = brute(rates, labels, 2.0, share, wing)
    assert found == want and len(want) > 5


def test_no_runs(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (1, 3.0, 1), (2, 3.0, 1)], "i long, rate double, label int")
    assert peaks.find_run_peaks(df).collect() == []  # the peak has no end on either side
    assert peaks.find_run_peaks(df.limit(0)).collect() == []
