import time

import numpy as np
import pandas as pd
import pytest

from wayline.operators import binning, signal
from wayline.storage import materialize


def test_many_taps_take_no_time():
    """Their sum is made once, not for each of them."""
    began = time.process_time()
    taps = binning.gaussian_taps(5000.0)
    assert len(taps) == 40_001 and np.isclose(sum(taps), 1) and time.process_time() - began < 1


@pytest.mark.parametrize("n, sigma, chunk", [(1000, 3.0, 100), (1000, 90.0, 64), (50, 40.0, 7), (1, 2.0, 10), (300, 1e-9, 128)])
def test_smoothing_wider_than_chunks(spark, n, sigma, chunk):
    p = np.random.default_rng(n).exponential(1, n)
    df = materialize(spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "power": p})).repartition(3), "power")
    got = signal._smoothed_power(df, sigma, chunk).orderBy("i").toPandas()
    taps = np.array(binning.gaussian_taps(sigma))
    want = np.convolve(np.pad(p, len(taps) // 2, mode="edge"), taps, "valid")
    assert got.i.tolist() == list(range(n)) and np.allclose(got.soft, want, rtol=1e-12)


def test_peak_of_a_wide_spectrum(spark):
    """Against numpy, with a Gaussian of some thousand samples, as it takes for long recordings."""
    fs, n = 50.0, 40_000
    f = np.arange(n) * (25.0 / n)
    p = np.random.default_rng(3).exponential(1, n) * (1 + 4 * np.exp(-((f - 8.3) ** 2)))
    got = signal.band_peak(spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "freq": f, "power": p})).repartition(4), 1.0, (6.0, 12.0)).first()
    taps = np.array(binning.gaussian_taps(n / fs * 2))
    soft = np.convolve(np.pad(p, len(taps) // 2, mode="edge"), taps, "valid")
    k = np.where((f > 6) & (f < 12), soft, 0).argmax()
    near = np.abs(f - f[k]) < 1
    assert np.isclose(got.peak_freq, f[k]) and np.isclose(got.peak_power, soft[k]) and np.isclose(got.s2n, soft[near].mean() / soft[~near].mean())
