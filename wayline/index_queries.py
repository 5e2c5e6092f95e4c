"""Queries over numbering, runs and membership, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import indexing, joins, peaks
from wayline.operators import binning as B
from wayline.operators import sequence as S
from wayline.queries import _EVENTS, _event_spans, query, r6
from wayline.sources import adapters as A


@query(" SELECT i, k > 0 AND (k & (k - 1)) = 0 AS power, CASE WHEN k <= 1 THEN 1 ELSE CAST(power(2, ceil(log2(k))) AS BIGINT) END AS next FROM ev")
def powers_of_2(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("long")
    return A.events(spark, sf).select("i", indexing.is_power_of_2(k).alias("power"), indexing.next_power_of_2(k).alias("next"))


@query(" SELECT i, k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS sub FROM ev")
def duplicate_index(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.duplicate_index(A.events(spark, sf).select("i", "k"), "k")


@query(" SELECT i, unnest(range(0, k % 5))::BIGINT AS k FROM ev")
def repeat_index(spark: SparkSession, sf: str) -> DataFrame:
    e = A.events(spark, sf).select("i", (F.col("k") % 5).alias("n"))
    return indexing.repeated(e, "n").select("i", "k")


@query(" SELECT i, row_number() OVER (ORDER BY i) - 1 AS at FROM ev WHERE v >= 50")
def reindex_masked(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.reindexed(A.events(spark, sf), F.col("v") >= 50).select("i", "at")


@query(" SELECT i, x1, y1, x2, y2 FROM (SELECT i, x AS x1, y AS y1, lead(x) OVER (ORDER BY i) AS x2, lead(y) OVER (ORDER BY i) AS y2 FROM pos) WHERE x2 IS NOT NULL")
def polyline_segments(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.segments(A.positions(spark, sf))


@query(" SELECT p.i // 100 AS run, round(sqrt(max(power(p.x - q.x, 2) + power(p.y - q.y, 2))), 6) AS width FROM pos p JOIN pos q ON p.i // 100 = q.i // 100 GROUP BY 1")
def run_widths(spark: SparkSession, sf: str) -> DataFrame:
    at = A.positions(spark, sf).withColumn("run", F.expr("i div 100"))
    return indexing.widths(at, "run").select("run", *r6("width"))


@query(
    """, l AS (SELECT i, CASE WHEN k < 30 THEN 0 WHEN k < 60 THEN 1 ELSE 2 END AS l FROM ev), c AS (SELECT *, l <> 0 AND coalesce(lag(l) OVER (ORDER BY i), 0) <> l AS st FROM l
), n AS (SELECT *, sum(st::INT) OVER (ORDER BY i) AS n FROM c), s AS (SELECT n, count(*) AS c, min(i) AS a FROM n WHERE l <> 0 GROUP BY n HAVING count(*) >= 3
), r AS (SELECT n, row_number() OVER (ORDER BY a) AS run FROM s)
SELECT n.i, coalesce(CASE WHEN l <> 0 THEN run END, 0)::BIGINT AS run FROM n LEFT JOIN r USING (n)"""
)
def label_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs through one of two labels that last three samples or more."""
    label = F.when(F.col("k") < 30, 0).when(F.col("k") < 60, 1).otherwise(2)
    runs = S.label_changes(A.events(spark, sf).select("i", label.alias("l")), "l", "run", least=3)
    return runs.select("i", "run")


@query(_EVENTS + " SELECT i FROM ev WHERE i NOT IN (SELECT ev.i FROM span JOIN ev ON t_s BETWEEN ta AND tb)")
def outside_events(spark: SparkSession, sf: str) -> DataFrame:
    spans = _event_spans(spark, sf)
    return joins.outside_spans(A.events(spark, sf).select("i", "t_s"), spans, "t_s", "ta", "tb", 3600.0).select("i")


@query(_EVENTS + ", n AS (SELECT DISTINCT tet, cell FROM es) SELECT i, tet, cell FROM ev SEMI JOIN n USING (tet, cell)")
def spikes_of_event_cells(spark: SparkSession, sf: str) -> DataFrame:
    """All spikes of cells that fire in an event."""
    inside = joins.interval_join(A.spikes(spark, sf), _event_spans(spark, sf), "t_s", "ta", "tb", 3600.0).select("tet", "cell").distinct()
    return A.spikes(spark, sf).join(inside, ["tet", "cell"], "left_semi").select(F.col("pos_i").alias("i"), "tet", "cell")


@query(" SELECT tet, k, n FROM (SELECT tet, k, count(*) AS n, row_number() OVER (PARTITION BY tet ORDER BY count(*) DESC, k) AS r FROM ev GROUP BY 1, 2) WHERE r = 1")
def most_frequent_value(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.most_frequent(A.events(spark, sf), "k", ("tet",))


@query(
    """ SELECT floor(v / 50)::BIGINT AS b, count(*) FILTER (WHERE tet = 'click') AS click, count(*) FILTER (WHERE tet = 'view') AS view FROM ev WHERE tet IN ('click', 'view') GROUP BY 1"""
)
def stacked_histogram(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["click", "view"]
    e = A.events(spark, sf).where(F.col("tet").isin(kinds)).select(F.floor(F.col("v") / 50).alias("b"), "tet")  # a bin of other types only has no row
    return e.groupBy("b").pivot("tet", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds).select("b", *kinds)


@query(" SELECT min(n) AS n FROM (SELECT count(*) AS n FROM ev GROUP BY cell ORDER BY n DESC LIMIT 3)")
def third_largest(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.kth_largest(A.events(spark, sf).groupBy("cell").agg(F.count("*").alias("n")), "n", 3)


@query(
    """, d AS (SELECT max(t_s) AS d FROM ev), c AS (SELECT tet, cell, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT floor(t_s / 600)::BIGINT AS b, count(*) AS n FROM ev JOIN c USING (tet, cell), d WHERE c.n / d.d <= 0.0001 GROUP BY 1"""
)
def mua_hist_slow_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Joint activity of cells whose mean rate is at most 0.0001 Hz."""
    return B.joint_activity(A.spikes(spark, sf), 600.0, 0.0001)


@query(
    """, n AS (SELECT count(*) AS n FROM ev), w0 AS (SELECT k, exp(-0.5 * power(k / 2.0::DOUBLE, 2)) AS w FROM (SELECT unnest(range(-8, 9)) AS k)), w AS (SELECT k, w / (SELECT sum(w) FROM w0) AS w FROM w0
), c AS (SELECT i, CASE WHEN tet = 'click' THEN 50 ELSE 0 END AS c FROM ev
), r AS (SELECT e.i, round(sum(w * c.c), 9) AS r FROM ev e, w, n JOIN c ON c.i = CASE WHEN e.i + w.k < 0 THEN -1 - e.i - w.k WHEN e.i + w.k >= n THEN 2 * n - 1 - e.i - w.k ELSE e.i + w.k END GROUP BY e.i
), l AS (SELECT i, r, CASE WHEN r >= 2 THEN r ELSE 0 END AS v FROM r), m AS (SELECT i, r, v, lag(v) OVER (ORDER BY i) AS a, lead(v) OVER (ORDER BY i) AS b FROM l
), p AS (SELECT m.i, m.r, (SELECT max(q.i) FROM r q WHERE q.i BETWEEN m.i - 500 AND m.i - 1 AND q.r < 0.5 * m.r) AS x, (SELECT min(q.i) FROM r q WHERE q.i BETWEEN m.i AND m.i + 499 AND q.r < 0.5 * m.r) AS y FROM m WHERE v > a AND v > b
), s AS (SELECT i, r, coalesce(x, greatest(i - 500, 0)) AS lft, coalesce(y, i + 500) AS rgt FROM p
), d AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s q WHERE q.lft < s.rgt AND s.lft < q.rgt AND (q.r > s.r OR q.r = s.r AND q.i > s.i)))
SELECT d.i, round(any_value(d.r), 6) AS rate, round(max(sqrt(power(g.x - h.x, 2) + power(g.y - h.y, 2))), 6) AS width
FROM d JOIN pos g ON g.i BETWEEN lft AND rgt JOIN pos h ON h.i BETWEEN g.i AND rgt GROUP BY d.i"""
)
def rate_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of the click rate, those that stand for themselves with the ground that they cover."""
    hits = A.events(spark, sf).select("i", ((F.col("tet") == "click").cast("int") * 50.0).alias("c"))
    rates = S.smooth(hits, "c", B.gaussian_taps(2.0), "rate").select("i", F.round("rate", 9).alias("rate"))  # equal but for rounding is equal
    return peaks.peak_widths(peaks.find_peaks(rates, "rate", 50.0), A.positions(spark, sf)).select("i", *r6("rate", "width"))
