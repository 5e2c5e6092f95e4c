"""Queries over signals and their DuckDB oracles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import signal
from wayline.queries import FS, query, r6
from wayline.sources import adapters as A

THETA = (6.0, 12.0)

_FILTER = """, h0 AS (SELECT k, (k - 25)::DOUBLE AS a, 0.42 - 0.5 * cos(pi() * k / 25) + 0.08 * cos(2 * pi() * k / 25) AS w FROM range(51) t(k)
), h1 AS (SELECT k, a, w * CASE WHEN a = 0 THEN (24 - 12) / 50.0::DOUBLE ELSE (sin(pi() * 24 / 50 * a) - sin(pi() * 12 / 50 * a)) / (pi() * a) END AS v FROM h0
), h AS (SELECT k, v / (SELECT sum(v * cos(pi() * 18 / 50 * a)) FROM h1) AS v FROM h1
), g AS (SELECT p.k - q.k AS j, sum(p.v * q.v) AS v FROM h p, h q GROUP BY 1
), e AS (SELECT (SELECT count(*) FROM ev) AS n, (SELECT v FROM ev WHERE i = 0) AS a, (SELECT v FROM ev ORDER BY i DESC LIMIT 1) AS b
), x AS (SELECT i, v FROM ev UNION ALL SELECT -i, 2 * a - v FROM ev, e WHERE i BETWEEN 1 AND 50
         UNION ALL SELECT 2 * (n - 1) - i, 2 * b - v FROM ev, e WHERE i BETWEEN n - 51 AND n - 2)"""


@query(_FILTER + " SELECT p.i, round(sum(x.v * g.v), 6) AS filtered FROM ev p, g, x WHERE x.i = p.i + g.j GROUP BY p.i")
def theta_filter(spark: SparkSession, sf: str) -> DataFrame:
    taps = signal.band_taps(51, *THETA, FS, "blackman")
    return signal.band_pass(A.events(spark, sf), F.col("v"), taps).select("i", *r6("filtered"))


def _theta(spark: SparkSession, sf: str) -> DataFrame:
    return signal.theta(A.events(spark, sf), "v", FS, THETA, bad=F.col("v") > 400)


_WAVE = (
    _FILTER.replace("(SELECT v FROM ev", "(SELECT v FROM gd").replace("SELECT i, v FROM ev UNION", "SELECT i, v FROM gd UNION").replace("FROM ev, e WHERE", "FROM gd, e WHERE").replace(", h0 AS", ", gd AS (SELECT i, CASE WHEN v > 400 THEN 0 ELSE v END AS v FROM ev), h0 AS")
    + """, fl AS (SELECT p.i, CASE WHEN any_value(p.v) > 400 THEN 0 ELSE sum(x.v * g.v) END AS re, any_value(p.v) > 400 AS bad FROM ev p, g, x WHERE x.i = p.i + g.j GROUP BY p.i
), l AS (SELECT 50 * CAST(ceil(count(*) / 50.0::DOUBLE) AS BIGINT) AS n FROM ev
), ct AS (SELECT k, 2.0::DOUBLE / n / tan(pi() * k / n) AS c FROM (SELECT unnest(range(1 - (SELECT n FROM l), (SELECT n FROM l), 2)) AS k), l
), qd AS (SELECT p.i, any_value(p.re) AS re, any_value(p.bad) AS bad, sum(s.re * c) AS im FROM fl p, fl s, ct WHERE ct.k = p.i - s.i GROUP BY p.i
), ph AS (SELECT *, CASE WHEN bad THEN 0 ELSE atan2(im, re) + pi() END AS phase FROM qd
), st AS (SELECT *, coalesce(lead(phase) OVER (ORDER BY i) - phase, 0) AS d FROM ph
), fq AS (SELECT *, (d - 2 * pi() * round(d / (2 * pi()))) * 50 / (2 * pi()) AS freq FROM st)"""
)


@query(
    _WAVE
    + """ SELECT i, round(CASE WHEN NOT bad THEN re END, 4) AS filtered, round(CASE WHEN NOT bad THEN phase END, 4) AS phase,
       round(CASE WHEN NOT bad THEN sqrt(re * re + im * im) END, 4) AS amp, round(CASE WHEN NOT bad AND freq BETWEEN 6 AND 12 THEN freq END, 4) AS freq FROM fq"""
)
def theta_wave(spark: SparkSession, sf: str) -> DataFrame:
    """Phase, amplitude and frequency; samples above 400 are bad."""
    return _theta(spark, sf).select("i", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("filtered", "phase", "amp", "freq")])


@query(
    _WAVE
    + """, bn AS (SELECT tet, floor(round(phase, 9) * 36 / pi())::INT % 72 AS b FROM ev JOIN fq USING (i) WHERE NOT bad), nb AS (SELECT tet, b, count(*) AS n FROM bn GROUP BY 1, 2)
SELECT tet, b, round(n / sum(n) OVER (PARTITION BY tet), 6) AS share FROM nb"""
)
def theta_hist(spark: SparkSession, sf: str) -> DataFrame:
    spikes = A.spikes(spark, sf).withColumnRenamed("pos_i", "eeg_i")
    wave = _theta(spark, sf).withColumn("phase", F.round("phase", 9))
    return signal.phase_histogram(spikes, wave, ("tet",)).select("tet", "b", *r6("share"))


@query(
    """, n AS (SELECT count(*) AS n, avg(v) AS m, CAST(power(2, ceil(log2(count(*)))) AS BIGINT) AS l FROM ev)
, f AS (SELECT unnest(range(0, (SELECT l FROM n) // 2 + 1)) AS k)
, s AS (SELECT f.k, sum((v - m) * cos(2 * pi() * ((f.k * i) % l) / l)) AS c, sum((v - m) * sin(2 * pi() * ((f.k * i) % l) / l)) AS d FROM f, ev, n GROUP BY f.k)
SELECT k AS i, round(k * 50.0::DOUBLE / l, 6) AS freq, round((c * c + d * d) / n, 3) AS power FROM s, n"""
)
def power_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return signal.power_spectrum(A.events(spark, sf), "v", FS).select("i", *r6("freq"), (F.round("power", 3) + F.lit(0.0)).alias("power"))


@query(
    """, n AS (SELECT count(*) AS n, avg(v) AS m, CAST(power(2, ceil(log2(count(*)))) AS BIGINT) AS l FROM ev)
, f AS (SELECT unnest(range(0, (SELECT l FROM n) // 2 + 1)) AS k)
, s AS (SELECT f.k, sum((v - m) * cos(2 * pi() * ((f.k * i) % l) / l)) AS c, sum((v - m) * sin(2 * pi() * ((f.k * i) % l) / l)) AS d FROM f, ev, n GROUP BY f.k)
, p AS (SELECT k, (c * c + d * d) / n AS p, l // 2 AS last FROM s, n), sg AS (SELECT 0.1875::DOUBLE / (50.0::DOUBLE / l) AS s FROM n), t0 AS (SELECT k, exp(-0.5 * power(k / s, 2)) AS w FROM sg, (SELECT unnest(range(-10000, 10001)) AS k) WHERE abs(k) <= floor(4 * s + 0.5))
, t AS (SELECT k, w / (SELECT sum(w) FROM t0) AS w FROM t0)
, o AS (SELECT a.k, a.k * 50.0::DOUBLE / l AS freq, sum(t.w * b.p) AS soft FROM n, p a, t JOIN p b ON b.k = greatest(least(a.k + t.k, a.last), 0) GROUP BY a.k, l)
, b AS (SELECT freq AS pf, soft AS pp FROM o WHERE freq > 6 AND freq < 12 ORDER BY soft DESC, freq LIMIT 1)
SELECT round(pf, 6) AS peak_freq, round(pp, 3) AS peak_power, round(avg(soft) FILTER (WHERE abs(freq - pf) < 1) / avg(soft) FILTER (WHERE abs(freq - pf) >= 1), 5) AS s2n FROM o, b GROUP BY pf, pp"""
)
def theta_power(spark: SparkSession, sf: str) -> DataFrame:
    """Peak of the smoothed spectrum in the band, and its ratio to the rest."""
    found = signal.band_peak(signal.power_spectrum(A.events(spark, sf), "v", FS), 0.1875, THETA)
    return found.select(*r6("peak_freq"), F.round("peak_power", 3).alias("peak_power"), F.round("s2n", 5).alias("s2n"))


@query()
def ripple_events(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts in the ripple band of the signal, read as if sampled 1000 times a second."""
    e = A.events(spark, sf).select("i", "v", F.col("k").cast("double").alias("k"))
    return signal.ripple_events(e, "v", 1000.0, "k", max_speed=math.inf, peak=2.0, least_s=0.004)


@query(
    """, b AS (SELECT i, v, v > 150 AS bad FROM ev)
SELECT i, round(CASE WHEN bad THEN 0 ELSE v END, 6) AS v, bad FROM b"""
)
def signal_bad_as(spark: SparkSession, sf: str) -> DataFrame:
    """The signal with bad samples replaced."""
    e = A.events(spark, sf).withColumn("bad", F.col("v") > 150)
    return e.select("i", signal.bad_as(F.col("v"), F.col("bad"), 0.0).alias("v"), "bad").select("i", *r6("v"), "bad")
