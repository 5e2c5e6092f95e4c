"""Filters, analytic signals and spectra of long fixed-rate signals.

A filter looks at a bounded stretch around a sample, so a signal is cut into
chunks with halos, each of which takes a few numpy steps; only spectra and the
analytic signal of a recording look at all samples, and their transforms are done
in two rounds of short ones. ``keys`` name
the recording; ``order`` numbers its samples from 0 without gaps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.circular import ratio
from wayline.operators.binning import gaussian_taps
from wayline.operators.detection import find_events
from wayline.operators.sequence import CHUNK, framed, smooth
from wayline.storage import materialize, read_batches

#: Seconds of signal on each side from which the amplitude of ripples is made.
ANALYTIC_S = 10.0
#: Values that one step of a spectrum's transform holds.
_BLOCK = 1 << 16


def band_taps(n: int, low: float, high: float, fs: float, window: str = "hamming") -> np.ndarray:
    """``n`` taps of a windowed ideal band-pass, of gain 1 at the band's centre."""
    at = np.arange(n) - (n - 1) / 2
    ideal = 2 * high / fs * np.sinc(2 * high / fs * at) - 2 * low / fs * np.sinc(2 * low / fs * at)
    taps = ideal * {"hamming": np.hamming, "blackman": np.blackman}[window](n)
    return taps / (taps * np.cos(math.pi * (low + high) / fs * at)).sum()


def in_chunks(
    df: DataFrame,
    value: Column,
    kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]],
    made: dict[str, str],
    halo: int,
    keys: tuple[str, ...] = (),
    order: str = "i",
    chunk: int = CHUNK,
    edge: str = "odd",
) -> DataFrame:
    """``keys, order`` and the columns ``made`` that ``kernel`` gives for each sample.

    ``kernel(x, inside)`` gets a stretch of the signal with ``halo`` samples on each
    side and gives arrays as long. Beyond the signal's ends, where ``inside`` does
    not hold, ``x`` is the signal turned about its end sample (an odd extension) or,
    if ``edge`` is ``nearest``, the end sample. A null sample counts as 0. No task holds more than a chunk and its halos.
    """
    at = F.floor(F.col(order) / F.lit(chunk))
    place = F.pmod(F.col(order), F.lit(chunk))
    reach = -(-halo // chunk)
    homes = [F.struct(at.alias("__c"), F.lit(True).alias("__home"))]
    for k in range(1, reach + 1):
        homes.append(F.when(place + F.lit(halo) >= F.lit(k * chunk), F.struct((at + k).alias("__c"), F.lit(False).alias("__home"))))
        homes.append(F.when(place - F.lit(halo) < F.lit((1 - k) * chunk), F.struct((at - k).alias("__c"), F.lit(False).alias("__home"))))
    part = df.select(*keys, F.col(order).cast("long").alias(order), F.coalesce(value.cast("double"), F.lit(0.0)).alias("__v"))
    wide = part.select("*", F.inline(F.filter(F.array(*homes), lambda s: s.isNotNull())))
    names = list(keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        home = rows["__home"].to_numpy()
        if not home.any():
            return rows[[*names, order]].iloc[:0].assign(**{c: [] for c in made})
        x = rows["__v"].to_numpy(float)
        first, last = np.flatnonzero(home)[[0, -1]]
        before, after = max(0, halo - first), max(0, halo - (len(x) - 1 - last))
        ends = {"mode": "reflect", "reflect_type": "odd"} if len(x) > 1 and edge == "odd" else {"mode": "edge"}
        inside = np.pad(np.ones(len(x), bool), (before, after))
        found = kernel(np.pad(x, (before, after), **ends), inside)
        out = rows.loc[home, [*names, order]]
        return out.assign(**{c: found[c][before + first : before + last + 1] for c in made})

    schema = ", ".join([f"{k} {part.schema[k].dataType.simpleString()}" for k in [*keys, order]] + [f"{c} {t}" for c, t in made.items()])
    return wide.groupBy(*keys, "__c").applyInPandas(run, schema)


def _convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Centred convolution with an odd number of taps, 0 beyond the ends."""
    n = 1 << (len(x) + len(taps) - 1).bit_length()
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(taps, n), n)
    return y[len(taps) // 2 : len(taps) // 2 + len(x)]


def _analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal of a stretch, with as many zeros after it."""
    n = 1 << (2 * len(x) - 1).bit_length()
    f = np.fft.fft(x, n)
    f[1 : n // 2] *= 2
    f[n // 2 + 1 :] = 0
    return np.fft.ifft(f)[: len(x)]


def band_pass(df: DataFrame, value: Column, taps: np.ndarray, to: str = "filtered", keys: tuple[str, ...] = (), order: str = "i", chunk: int = CHUNK) -> DataFrame:
    """``keys, order, to``: filtered forwards and backwards, which shifts no phase; ends are extended oddly.

    Both ways together are one symmetric filter, the taps' own correlation.
    """
    both = np.convolve(taps, taps[::-1])
    return in_chunks(df, value, lambda x, inside: {to: _convolved(x, both)}, {to: "double"}, len(both) // 2, keys, order, chunk)


def _band_analytic(taps: np.ndarray, fs: float) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], int]:
    both, halo = np.convolve(taps, taps[::-1]), int(ANALYTIC_S * fs)

    def of(x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return _analytic(np.where(inside, _convolved(x, both), 0.0))

    return of, halo + len(both) // 2


def theta(
    df: DataFrame, value: str, fs: float, band: tuple[float, float] = (6.0, 12.0), bad: Column | None = None, keys: tuple[str, ...] = (), order: str = "i", chunk: int = CHUNK
) -> DataFrame:
    """``keys, order, filtered, phase, amp, freq`` of a signal in a band.

    The band is cut out by a Blackman filter of one second; ``phase`` is in 0 to 2
    pi, ``freq`` the step of the phase to the next sample in Hz. Where ``bad``
    holds the signal counts as 0, before and after the filter, and all four are
    null; so is a ``freq`` outside the band. The analytic signal is that of the whole
    recording, filled up with zeros to whole seconds.
    """
    spoilt = F.coalesce(bad, F.lit(False)) if bad is not None else F.lit(False)
    taps = band_taps(int(fs) + 1 - int(fs) % 2, *band, fs, "blackman")
    cut = band_pass(df, F.when(~spoilt, F.col(value)), taps, "filtered", keys, order, chunk)
    flags = df.select(*keys, F.col(order).cast("long").alias(order), spoilt.alias("__bad"))
    cut = materialize(cut.join(flags, [*keys, order]).withColumn("filtered", F.when(F.col("__bad"), 0.0).otherwise(F.col("filtered"))), "filtered")
    both = cut.join(quadrature(cut, "filtered", int(fs), "imag", keys, order), [*keys, order])
    phase = F.when(F.col("__bad"), F.lit(0.0)).otherwise(F.atan2("imag", "filtered") + math.pi)
    return _with_freq(both.withColumn("phase", phase), fs, band, keys, order, chunk)


def _with_freq(both: DataFrame, fs: float, band: tuple[float, float], keys: tuple[str, ...], order: str, chunk: int) -> DataFrame:
    near = framed(both, {"__next": lambda w: F.lead("phase").over(w)}, 0, 1, keys, order, chunk)
    step = F.coalesce(F.col("__next") - F.col("phase"), F.lit(0.0))
    wrapped = step - 2 * math.pi * F.round(step / (2 * math.pi))
    freq = wrapped * (fs / (2 * math.pi))
    good = lambda c: F.when(~F.col("__bad"), c)
    return near.select(
        *keys,
        order,
        good(F.col("filtered")).alias("filtered"),
        good(F.col("phase")).alias("phase"),
        good(F.hypot("filtered", "imag")).alias("amp"),
        good(F.when(freq.between(*band), freq)).alias("freq"),
    )


def phase_histogram(spikes: DataFrame, phases: DataFrame, keys: tuple[str, ...], bin_deg: float = 5.0, at: str = "eeg_i", order: str = "i") -> DataFrame:
    """``keys, b, share``: how each cell's spikes are dealt out over the phase; those at a null phase don't count.

    Only bins that hold a spike have a row. A phase of a whole turn is in bin 0.
    """
    if 360 % bin_deg:
        raise ValueError("bins must divide the circle")
    n = int(360 / bin_deg)
    met = spikes.join(phases.select(F.col(order).alias(at), "phase"), at).where("phase is not null")
    b = F.pmod(F.floor(F.col("phase") * (180 / bin_deg / math.pi)).cast("int"), F.lit(n))
    counts = met.groupBy(*keys, b.alias("b")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("__all"))
    return counts.join(totals, list(keys)).select(*keys, "b", ratio(F.col("n"), F.col("__all")).alias("share"))


def ripple_amplitude(
    df: DataFrame, value: str, fs: float, band: tuple[float, float] = (150.0, 250.0), n_taps: int = 401, smooth_ms: float = 5.0, order: str = "i", chunk: int = CHUNK
) -> DataFrame:
    """``order, filtered, amp``: a signal in the ripple band and its Gaussian-smoothed amplitude."""
    of, halo = _band_analytic(band_taps(n_taps, *band, fs), fs)

    def kernel(x: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
        a = of(x, inside)
        return {"filtered": a.real, "raw": np.abs(a)}

    amp = in_chunks(df, F.col(value), kernel, {"filtered": "double", "raw": "double"}, halo, (), order, chunk)
    return smooth(amp, "raw", gaussian_taps(smooth_ms / 1000 * fs), "amp").drop("raw")


def ripple_events(
    lfp: DataFrame,
    value: str,
    fs: float,
    speed: str | None = None,
    band: tuple[float, float] = (150.0, 250.0),
    smooth_ms: float = 5.0,
    peak: float = 3.0,
    max_speed: float = 10.0,
    least_s: float = 0.04,
) -> DataFrame:
    """``event, first_i, last_i, n_islands, z_peak, v_peak, start_s, end_s``: bursts of ripple amplitude.

    ``lfp`` has a dense ``i``, the signal and, if asked for, the speed at each
    sample. Candidates and their selection are those of :func:`find_events`;
    ``least_s`` is what parts two events and what an event must exceed.
    """
    keep = ["i", *([speed] if speed else [])]
    amp = materialize(ripple_amplitude(lfp, value, fs, band, smooth_ms=smooth_ms).join(lfp.select(*keep), "i"), "ripples")  # read several times
    found = find_events(amp, "amp", speed, peak, max_speed, int(least_s * fs), int(least_s * fs))
    return found.withColumns({"start_s": F.col("first_i") / fs, "end_s": F.col("last_i") / fs})


def find_replay_events(method: str, lfp: DataFrame | None, activity: DataFrame, fs: float, activity_fs: float, speed: str | None = None) -> DataFrame:
    """Candidate events by ``SWR`` from a fast field signal, or by ``MUA`` from the cells' joint activity.

    Without a field signal there are no ``SWR`` events: the table is empty, its
    columns are the same.
    """
    if method not in ("SWR", "MUA"):
        raise ValueError(f"unknown method: {method}")
    if method == "SWR" and lfp is not None:
        return ripple_events(lfp, "v", fs, speed)
    close = int(0.04 * activity_fs)
    found = find_events(activity, "v", speed, close=close, min_samples=close)
    found = found.withColumns({"start_s": F.col("first_i") / activity_fs, "end_s": F.col("last_i") / activity_fs})
    return found if method == "MUA" else found.limit(0)


# -- spectra -----------------------------------------------------------------


def _factors(n: pd.Series) -> pd.DataFrame:
    """Each length as a product of two that are as near as may be."""
    first = [next(d for d in range(math.isqrt(k), 0, -1) if k % d == 0) if k else 1 for k in n.tolist()]
    return pd.DataFrame({"n1": first, "n2": [k // d if k else 1 for k, d in zip(n.tolist(), first)]})


def _transform(rows: DataFrame, keys: tuple[str, ...], inverse: bool = False) -> DataFrame:
    """``keys, pos, re, im, n1, n2``: the discrete Fourier transform of series ``keys, pos, re, im`` of ``n1 * n2`` samples.

    Missing samples are 0. A series is read as a matrix of n1 rows and n2 columns:
    its columns are transformed, turned by their place, and then its rows, so a
    task holds a block of columns or rows.
    """
    names, sign = list(keys), 2j if inverse else -2j
    types = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*types, "a long, b long, re double, im double, n1 long, n2 long"])

    def step(first: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(part: pd.DataFrame) -> pd.DataFrame:
            n1, n2 = int(part["n1"].iloc[0]), int(part["n2"].iloc[0])
            length, n = n1 if first else n2, n1 * n2
            outer, which = np.unique(part["a"].to_numpy(), return_inverse=True)
            m = np.zeros((len(outer), length), complex)
            np.add.at(m, (which, part["b"].to_numpy()), part["re"].to_numpy() + 1j * part["im"].to_numpy())
            m = np.fft.ifft(m, axis=1) if inverse else np.fft.fft(m, axis=1)
            inner = np.arange(length)
            if first:
                m *= np.exp(sign * math.pi * ((outer[:, None] * inner[None, :]) % n) / n)
            made = {k: [part[k].iloc[0]] * m.size for k in names}
            return pd.DataFrame({**made, "a": np.repeat(outer, length), "b": np.tile(inner, len(outer)), "re": m.real.ravel(), "im": m.imag.ravel(), "n1": n1, "n2": n2})

        return run

    whole = rows.select(*keys, (F.col("pos") % F.col("n2")).alias("a"), F.floor(F.col("pos") / F.col("n2")).alias("b"), "re", "im", "n1", "n2")
    columns = whole.groupBy(*keys, F.floor(F.col("a") * F.col("n1") / _BLOCK)).applyInPandas(step(True), schema)
    turned = columns.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "re", "im", "n1", "n2")
    found = turned.groupBy(*keys, F.floor(F.col("a") * F.col("n2") / _BLOCK)).applyInPandas(step(False), schema)
    return found.select(*keys, (F.col("a") + F.col("b") * F.col("n1")).alias("pos"), "re", "im", "n1", "n2")


def quadrature(df: DataFrame, value: str, whole: int, to: str = "imag", keys: tuple[str, ...] = (), order: str = "i") -> DataFrame:
    """``keys, order, to``: the imaginary part of the analytic signal of whole recordings, whose real part is ``value``.

    A recording is filled up with zeros to a multiple of ``whole`` samples. Of its
    transform the upper half is left out and what lies between its ends doubled;
    then it is transformed back. Nulls count as 0. Where the length has a large prime factor,
    a task holds as many samples.
    """
    at = F.col(order).cast("long")
    ends = df.groupBy(*keys).agg((F.max(at) + 1).alias("__n"))
    product = F.pandas_udf(_factors, "n1 long, n2 long")
    sized = ends.select(*keys, (F.ceil(F.col("__n") / whole) * whole).alias("n")).select(*keys, product("n").alias("f")).select(*keys, "f.*")
    rows = df.select(*keys, at.alias("pos"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    rows = rows.join(sized, list(keys)) if keys else rows.crossJoin(F.broadcast(sized))  # one row
    n = F.col("n1") * F.col("n2")
    weight = F.when((F.col("pos") == 0) | (F.col("pos") * 2 == n), 1.0).otherwise(2.0)
    half = _transform(rows, keys).where(F.col("pos") * 2 <= n).withColumns({"re": F.col("re") * weight, "im": F.col("im") * weight})
    back = _transform(half, keys, inverse=True)
    known = df.select(*keys, at.alias(order))
    return back.select(*keys, F.col("pos").alias(order), F.col("im").alias(to)).join(known, [*keys, order], "left_semi")


def spectrum(df: DataFrame, value: Column, n: int, keys: tuple[str, ...] = (), order: str = "i") -> DataFrame:
    """``keys, k, re, im`` for k from 0 to n / 2: the discrete Fourier transform of ``n`` samples; missing and null ones count as 0."""
    if n < 1:
        raise ValueError("there is no sample")
    f = _factors(pd.Series([n])).iloc[0]
    inside = df.where((F.col(order) >= 0) & (F.col(order) < n))
    x = F.coalesce(value.cast("double"), F.lit(0.0)).alias("re")
    rows = inside.select(*keys, F.col(order).cast("long").alias("pos"), x, F.lit(0.0).alias("im"), F.lit(int(f.n1)).alias("n1"), F.lit(int(f.n2)).alias("n2"))
    found = _transform(rows.withColumns({"n1": F.col("n1").cast("long"), "n2": F.col("n2").cast("long")}), keys)
    return found.where(F.col("pos") * 2 <= n).select(*keys, F.col("pos").alias("k"), "re", "im")


def power_spectrum(df: DataFrame, value: str, fs: float, max_freq: float = 125.0) -> DataFrame:
    """``i, freq, power`` of one recording: squared size of its transform by the number of samples, its mean taken out.

    The length is filled up with zeros to a power of 2; ``i`` counts frequencies from 0.
    """
    size = df.agg(F.count("*").alias("n"), F.max("i").alias("last"), F.avg(value).alias("mean")).first()
    n = 1 << max(0, (size.last or 0)).bit_length()
    mean = size.mean or 0.0
    s = spectrum(df, F.coalesce(F.col(value) - F.lit(mean), F.lit(0.0)), n)
    freq = F.col("k") * (fs / n)
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / max(1, size.n)
    return s.select(F.col("k").alias("i"), freq.alias("freq"), power.alias("power")).where(F.col("freq") <= max_freq)


def _correlated(x: np.ndarray, taps: np.ndarray, block: int) -> np.ndarray:
    """Sums of ``taps`` times the samples from each place on, where all are there; of ``block`` taps at a time."""
    size = len(x) - len(taps) + 1
    n = 1 << (size + min(block, len(taps)) - 2).bit_length()
    out = np.zeros(size)
    for a in range(0, len(taps), block):
        part = taps[a : a + block]
        y = np.fft.irfft(np.fft.rfft(x[a : a + len(part) - 1 + size], n) * np.fft.rfft(part[::-1], n), n)
        out += y[len(part) - 1 : len(part) - 1 + size]
    return out


def _smoothed_power(power: DataFrame, sigma: float, chunk: int = 1 << 18) -> DataFrame:
    """``i, soft``: ``power``, kept in files with ``i`` dense from 0, under a Gaussian of ``sigma`` samples; goes on beyond its ends with its end samples.

    The Gaussian may be many chunks wide, so a task reads what lies around its chunk
    from the files instead of getting copies of rows.
    """
    path, spark = power._wayline_path, power.sparkSession
    last = power.agg(F.max("i")).first()[0]
    if last is None:
        return power.select("i", F.col("power").alias("soft"))
    ends = {r.i: r.power for r in power.where(F.col("i").isin(0, last)).collect()}
    r = int(4 * sigma + 0.5)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        taps /= taps.sum()
        for part in parts:
            for c in part["id"].tolist():
                first, after = c * chunk, min(c * chunk + chunk, last + 1)
                x = np.full(after - first + 2 * r, ends[0])
                x[max(0, last + 1 - first + r) :] = ends[last]
                for i, v in read_batches(path, ("i", "power"), "i", first - r, after + r):
                    x[i - (first - r)] = v
                yield pd.DataFrame({"i": np.arange(first, after), "soft": _correlated(x, taps, chunk)})

    n = last // chunk + 1
    return materialize(spark.range(0, n, 1, n).mapInPandas(run, "i long, soft double"), "soft")


def band_peak(power: DataFrame, smoothing_hz: float, band: tuple[float, float], width: float = 2.0) -> DataFrame:
    """``peak_freq, peak_power, s2n`` of a smoothed power spectrum.

    The largest power inside the band, ties to the lower frequency, and the mean
    power less than half of ``width`` from it by the mean of the rest.
    """
    kept = power.select(F.col("i").cast("long").alias("i"), "freq", F.coalesce("power", F.lit(0.0)).alias("power"))
    kept = materialize(kept.repartitionByRange("i").sortWithinPartitions("i"), "power")  # tasks read stretches of it
    step = kept.where("i = 1").agg(F.max("freq")).first()[0] or 1.0
    sigma = max(smoothing_hz / step, 1e-9)
    soft = _smoothed_power(kept, sigma).withColumn("freq", F.col("i") * step)
    inside = (F.col("freq") > band[0]) & (F.col("freq") < band[1])
    best = soft.where(inside).agg(F.max(F.struct(F.col("soft"), (-F.col("freq")).alias("f"))).alias("best"))
    best = best.select((-F.col("best.f")).alias("peak_freq"), F.col("best.soft").alias("peak_power"))
    near = F.abs(F.col("freq") - F.col("peak_freq")) < width / 2
    joined = soft.crossJoin(F.broadcast(best))  # one row
    return joined.groupBy("peak_freq", "peak_power").agg(ratio(F.avg(F.when(near, F.col("soft"))), F.avg(F.when(~near, F.col("soft")))).alias("s2n"))


def bad_as(value: Column, bad: Column, to: float | None = None) -> Column:
    """A signal with bad samples replaced by ``to``, null by default; a null flag is not bad."""
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(to).cast("double")).otherwise(value.cast("double"))


def low_spectrum(df: DataFrame, value: str, most: int, length: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, ky, kx, re, im``: a map's two-dimensional transform at the frequencies -most to most, of a period ``length``.

    Only few frequencies are asked for, so each is a sum over bins: partial sums
    where the bins lie. Null bins count as 0.
    """
    span = F.sequence(F.lit(-most), F.lit(most))
    some = df.select(*keys, "gy", "gx", F.coalesce(F.col(value), F.lit(0.0)).alias("v"), F.explode(span).alias("ky")).select("*", F.explode(span).alias("kx"))
    angle = (F.col("ky") * F.col("gy") + F.col("kx") * F.col("gx")) * (-2 * math.pi / length)
    return some.groupBy(*keys, "ky", "kx").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))


def slope_taps(width: int, order: int = 2) -> list[float]:
    """Weights whose centred sum is the slope of the least-squares polynomial through ``width`` (odd) samples."""
    at = np.arange(width) - width // 2
    return np.linalg.pinv(np.vander(at.astype(float), order + 1, increasing=True))[1].tolist()
