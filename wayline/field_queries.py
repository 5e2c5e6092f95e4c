"""Queries over fields, lattices and shifts of maps, and their DuckDB oracles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import binning as B
from wayline.operators import fields, grids, joins, maps, peaks, resampling, rhythm, shapes, tracking
from wayline.operators import sequence as S
from wayline.queries import CELL, FS, SHAPE, SIZE, _half, _map, query, r6
from wayline.sources import adapters as A


@query()
def ideal_grid_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Best lattice of each cell type's spikes: 60 orientations, 20 scales, all shifts."""
    e = A.events(spark, sf).select("i", (F.col("tet") == CELL).cast("int").alias("spk"))
    dealt = A.positions(spark, sf).join(e, "i").repartition(spark.sparkContext.defaultParallelism, "i")  # much to do for each row
    return grids.fit_ideal_grid(dealt)


_PEAKS = f""", c AS (SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) FILTER (WHERE tet = '{CELL}')::DOUBLE AS w FROM pos JOIN ev USING (i) GROUP BY 1, 2
), pk AS (SELECT (gx - 5)::DOUBLE AS x, (gy - 5)::DOUBLE AS y, w FROM c ORDER BY w DESC, gy, gx LIMIT 12)"""


@query(
    _PEAKS
    + """, o AS (SELECT k * pi() / 3 / 12 AS orient FROM range(12) t(k)), s AS (SELECT 3 + k * 0.5::DOUBLE AS scale FROM range(8) t(k))
, v AS (SELECT a.k / 6.0::DOUBLE AS u, b.k / 5.0::DOUBLE AS v FROM range(6) a(k), range(5) b(k))
, q AS (SELECT orient, scale, u, v, w, (x * cos(orient) + y * sin(orient)) / scale - u AS p, (y * cos(orient) - x * sin(orient)) / (sqrt(3) / 2) / scale - v AS t FROM o, s, v, pk)
, r AS (SELECT *, unnest([floor(t), floor(t) + 1]) AS k FROM q)
, d AS (SELECT orient, scale, u, v, w, p, t, min(power(p - (k % 2) * 0.5 - round(p - (k % 2) * 0.5), 2) + power((t - k) * sqrt(3) / 2, 2)) * scale * scale AS d FROM r GROUP BY orient, scale, u, v, w, p, t)
, f AS (SELECT orient, scale, u, v, round(sum(d * w), 9) AS cost FROM d GROUP BY 1, 2, 3, 4)
SELECT round(cost, 5) AS cost, round(orient, 6) AS orient, scale, round(u, 6) AS u, round(v, 6) AS v FROM f ORDER BY f.cost, f.orient, f.scale, f.u, f.v LIMIT 1"""
)
def lattice_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The lattice nearest to a map's twelve strongest bins."""
    m = _map(spark, sf, None, "counts").where("dwell > 0").orderBy(F.desc("spk"), "gy", "gx").limit(12)
    peaks = m.select((F.col("gx") - 5.0).alias("x"), (F.col("gy") - 5.0).alias("y"), F.col("spk").alias("w"))
    fit = grids.fit_lattice(peaks, 12, [3 + k * 0.5 for k in range(8)], 6)
    return fit.select((F.round("cost", 5) + F.lit(0.0)).alias("cost"), *r6("orient"), "scale", *r6("u", "v"))


@query()
def warp_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """How the map of one half of the recording must be moved to match the other's, bin by bin."""
    return grids.warp(_half(spark, sf, False), _half(spark, sf, True), 3, 2.0)


_DRIFT = f""", m AS (SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, (count(*) FILTER (WHERE tet = '{CELL}') + 0.5::DOUBLE) / count(*) AS r FROM pos JOIN ev USING (i) GROUP BY 1, 2
), g AS (SELECT (r // 11)::INT AS gy, (r % 11)::INT AS gx FROM range(121) t(r)
), fm AS (SELECT gy, gx, r FROM (SELECT g.gy, g.gx, m.r, row_number() OVER (PARTITION BY g.gy, g.gx ORDER BY power(g.gy - m.gy, 2) + power(g.gx - m.gx, 2), m.gy, m.gx) AS rk FROM g, m) WHERE rk = 1
), sm AS (SELECT i // 100 AS run, floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, (tet = '{CELL}')::INT AS k FROM pos JOIN ev USING (i)
), mv AS (SELECT (r // 9 - 4)::INT AS dy, (r % 9 - 4)::INT AS dx FROM range(81) t(r)
), ll AS (SELECT run, dy, dx, sum(k * ln(r) - r) AS ll FROM sm, mv JOIN fm ON fm.gy = greatest(least(sm.gy + dy, 10), 0) AND fm.gx = greatest(least(sm.gx + dx, 10), 0) GROUP BY 1, 2, 3
), w AS (SELECT *, exp(g) AS w FROM (SELECT *, round(ll - max(ll) OVER (PARTITION BY run), 6) AS g FROM ll))"""


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of 100 samples; half a spike is added to each bin so that no rate is 0."""
    m = B.rate_map(A.positions(spark, sf), joins.gather(A.spikes(spark, sf).where(F.col("tet") == CELL), A.positions(spark, sf)), SIZE, SHAPE, FS, None, "counts")
    m = B.fill_unvisited(m.select("gy", "gx", F.when(F.col("dwell") > 0, (F.col("spk") + 0.5) / F.col("dwell")).alias("rate")), "nearest")
    k = A.events(spark, sf).select("i", (F.col("tet") == CELL).cast("int").alias("k"))
    at = A.positions(spark, sf).join(k, "i").select(F.expr("i div 100").alias("run"), B.xy_bin(F.col("y"), SIZE).alias("gy"), B.xy_bin(F.col("x"), SIZE).alias("gx"), "k")
    return grids.drift_likelihood(at, m, SHAPE, 4)


@query(_DRIFT + " SELECT run, round(sum(w * dy) / sum(w), 5) AS dy, round(sum(w * dx) / sum(w), 5) AS dx FROM w GROUP BY run")
def drift_mle(spark: SparkSession, sf: str) -> DataFrame:
    return grids.drift(_drift(spark, sf), "mean").select("run", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("dy", "dx")])


@query(
    _DRIFT
    + """, nb AS (SELECT a.run, a.dy, a.dx, a.w, a.g, max(b.g) AS mx FROM w a JOIN w b ON a.run = b.run AND abs(a.dy - b.dy) <= 1 AND abs(a.dx - b.dx) <= 1 GROUP BY 1, 2, 3, 4, 5
), rg AS (SELECT *, max(g) OVER (PARTITION BY run ORDER BY dy * dy + dx * dx RANGE UNBOUNDED PRECEDING) AS below, sum(w) OVER (PARTITION BY run) AS s FROM nb
), pk AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY dy * dy + dx * dx, dy, dx) AS rk FROM rg WHERE g = mx AND g >= below)
SELECT r.run, dy::DOUBLE AS dy, dx::DOUBLE AS dx, round(w / s, 6) AS p FROM (SELECT DISTINCT run FROM w) r LEFT JOIN pk ON pk.run = r.run AND rk = 1"""
)
def drift_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return grids.drift(_drift(spark, sf)).select("run", "dy", "dx", *r6("p"))


@query(
    """, s AS (SELECT i, x, y, power(x - 50, 2) + power(y - 50, 2) > 48 * 48 AS out_circle, 45 - sqrt(power(x - 50, 2) + power(y - 50, 2)) AS to_circle,
       x < 10 OR x > 90 OR y < 5 OR y > 95 AS out_box, least(abs(x - 10), abs(x - 90), abs(y - 5), abs(y - 95)) AS to_box FROM mpos WHERE x IS NOT NULL)
SELECT i, out_circle, round(to_circle, 6) AS to_circle, out_box, round(to_box, 6) AS to_box FROM s"""
)
def arena_shapes(spark: SparkSession, sf: str) -> DataFrame:
    p = A.positions(spark, sf, masked=True).where("x is not null")
    circle, box, at = shapes.Circle(50.0, 50.0, 45.0), shapes.Rectangle(10.0, 90.0, 5.0, 95.0), (F.col("x"), F.col("y"))
    made = p.select("i", circle.is_outside(*at, 3.0).alias("out_circle"), circle.distance(*at).alias("to_circle"), box.is_outside(*at).alias("out_box"), box.distance(*at).alias("to_box"))
    return made.select("i", "out_circle", *r6("to_circle"), "out_box", *r6("to_box"))


@query(
    f""", s AS (SELECT i AS a, x, y FROM pos JOIN ev USING (i) WHERE tet = '{CELL}'), n AS (SELECT count(*) AS n FROM pos)
, w AS (SELECT a, x, y, greatest(a - 100, 0) AS lo, least(greatest(a + 101, 0), n - 1) AS hi FROM s, n)
, dd AS (SELECT floor((p.y - w.y) / 10 + 0.5)::INT AS dy, floor((p.x - w.x) / 10 + 0.5)::INT AS dx, count(*) AS c FROM w JOIN pos p ON p.i >= lo AND p.i < hi AND (p.i - lo) % 5 = 0 GROUP BY 1, 2)
, ss AS (SELECT floor((b.y - w.y) / 10 + 0.5)::INT AS dy, floor((b.x - w.x) / 10 + 0.5)::INT AS dx, count(*) AS c FROM w JOIN s b ON b.a > w.a AND b.a < hi GROUP BY 1, 2)
, g AS (SELECT (r // 23 - 11)::INT AS dy, (r % 23 - 11)::INT AS dx FROM range(529) t(r))
, h AS (SELECT g.dy, g.dx, coalesce(dd.c, 0)::DOUBLE AS dwell, (coalesce(p.c, 0) + coalesce(q.c, 0))::DOUBLE AS spk FROM g LEFT JOIN dd ON dd.dy = g.dy AND dd.dx = g.dx
        LEFT JOIN ss p ON p.dy = g.dy AND p.dx = g.dx LEFT JOIN ss q ON q.dy = -g.dy AND q.dx = -g.dx)
, k AS (SELECT a.k AS ky, b.k AS kx FROM (SELECT unnest([-1, 0, 1]) k) a, (SELECT unnest([-1, 0, 1]) k) b)
SELECT h.dy, h.dx, round(CASE WHEN h.dwell > 100 THEN sum(o.spk) / sum(o.dwell) END, 6) AS rate
FROM h, k JOIN h o ON o.dy = greatest(least(h.dy + ky, 11), -11) AND o.dx = greatest(least(h.dx + kx, 11), -11) GROUP BY h.dy, h.dx, h.dwell"""
)
def spa_ac_windowed(spark: SparkSession, sf: str) -> DataFrame:
    """Displacements within two seconds of a cell's spikes."""
    spikes = A.spikes(spark, sf).where(F.col("tet") == CELL)
    m = maps.windowed_autocorrelation(spikes, A.positions(spark, sf), 100, 5, SIZE, (110.0, 110.0), 3, 100)
    return m.select("dy", "dx", *r6("rate"))


@query(
    f""", fl AS (SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, (count(*) FILTER (WHERE tet = '{CELL}') >= 10)::INT AS label FROM pos JOIN ev USING (i) GROUP BY 1, 2)
SELECT i, coalesce(label, 0) > 0 AS inside FROM pos LEFT JOIN fl ON gy = floor(y / 10) AND gx = floor(x / 10)"""
)
def position_in_field(spark: SparkSession, sf: str) -> DataFrame:
    m = _map(spark, sf, None, "counts").select("gy", "gx", (F.col("spk") >= 10).cast("int").alias("rate"))
    at = B.rate_at(A.positions(spark, sf), m, SIZE, "label")
    return at.select("i", (F.coalesce("label", F.lit(0)) > 0).alias("inside"))


@query(" SELECT round(degrees(atan2(sum(sin(6 * radians(3.6 * k))), sum(cos(6 * radians(3.6 * k))))) / 6, 6) AS mean, cell FROM ev GROUP BY cell")
def circ_mean_60(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("k") * math.radians(3.6) * 6
    return A.events(spark, sf).groupBy("cell").agg((F.degrees(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a)))) / 6).alias("mean")).select(*r6("mean"), "cell")


@query()
def rhythmicity_mle(spark: SparkSession, sf: str) -> DataFrame:
    """Rhythm of each kind of event, a minute of the recording read as a millisecond."""
    fast = A.spikes(spark, sf).withColumn("t_s", F.col("t_s") / 60_000)
    return rhythm.rhythmicity(fast, keys=("tet",))


@query(
    """, g AS (SELECT tet, i // 50 AS label, avg(v) AS m FROM ev WHERE tet IN ('click', 'view') AND i >= 50 GROUP BY 1, 2
), b AS (SELECT tet, label, floor(m / 20)::BIGINT AS bin FROM g), n AS (SELECT bin, least(count(*) FILTER (WHERE tet = 'click'), count(*) FILTER (WHERE tet = 'view')) AS n FROM b GROUP BY 1
), r AS (SELECT *, row_number() OVER (PARTITION BY tet, bin ORDER BY ('0x' || substr(md5('0:' || CASE WHEN tet = 'click' THEN 'a' ELSE 'b' END || ':' || label), 1, 15))::BIGINT, label) AS rk FROM b JOIN n USING (bin))
SELECT CASE WHEN tet = 'click' THEN 'a' ELSE 'b' END AS side, label, row_number() OVER (PARTITION BY tet ORDER BY label) AS "to" FROM r WHERE rk <= n"""
)
def matched_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of two kinds of event, matched by their mean signal."""
    e = A.events(spark, sf).select("tet", F.expr("i div 50").alias("label"), F.col("v").alias("value"))
    return resampling.matched(e.where(F.col("tet") == "click"), e.where(F.col("tet") == "view"), 20.0)


@query(
    """, wd AS (SELECT max(x) * 5.0::DOUBLE / 100 AS w FROM pos), bn AS (SELECT i, x, y, least(floor(x / w), 19)::BIGINT AS bin FROM pos, wd WHERE x >= 0
), pl AS (SELECT bin, x, y, row_number() OVER (PARTITION BY bin ORDER BY i) - 1 AS z FROM bn), sz AS (SELECT bin, count(*) AS n FROM bn GROUP BY 1
), pk AS (SELECT bin, rep, n, unnest(range(1, (SELECT min(n) FROM sz) + 1)) AS d FROM sz, (SELECT unnest(range(1, 101)) AS rep)
), dr AS (SELECT bin, rep, ('0x' || substr(md5('0:' || rep || ':' || bin || ':' || d), 1, 15))::BIGINT % n AS z FROM pk
), r AS (SELECT rep, corr(x, y) AS r FROM dr JOIN pl USING (bin, z) GROUP BY rep)
SELECT (SELECT count(*) FROM sz)::INT AS n_bins, round(avg(r), 6) AS r, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM r"""
)
def pearson_binned(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.binned_bootstrap(A.positions(spark, sf)).select("n_bins", *r6("r", "low", "high"))


@query()
def ellipse_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The ellipse through each cell's positions."""
    at = A.positions(spark, sf).join(A.events(spark, sf).select("i", "cell"), "i")
    return tracking.fit_ellipse(at, ("cell",))


@query(
    f""", c AS (SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) FILTER (WHERE tet = '{CELL}') AS n FROM pos JOIN ev USING (i) GROUP BY 1, 2
), t AS (SELECT gy * 11 + gx AS name, (gx + 0.5::DOUBLE) * 10 AS tx, (gy + 0.5::DOUBLE) * 10 AS ty FROM c WHERE n > 0 AND n >= ALL (SELECT q.n FROM c q WHERE abs(q.gy - c.gy) <= 1 AND abs(q.gx - c.gx) <= 1)
), d AS (SELECT i, name, round(sqrt(power(x - tx, 2) + power(y - ty, 2)), 9) AS d FROM pos JOIN ev USING (i), t WHERE tet = '{CELL}')
SELECT i, name AS "to", round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, name) AS rk FROM d) WHERE rk = 1"""
)
def dist_to_peak(spark: SparkSession, sf: str) -> DataFrame:
    """Each spike's nearest peak of its cell's map."""
    peaks = maps.regional_maxima(_map(spark, sf, None, "counts").select("gy", "gx", F.col("spk").alias("rate")))
    targets = peaks.select((F.col("gy") * 11 + F.col("gx")).alias("name"), ((F.col("gx") + 0.5) * SIZE).alias("tx"), ((F.col("gy") + 0.5) * SIZE).alias("ty"))
    spikes = joins.gather(A.spikes(spark, sf).where(F.col("tet") == CELL), A.positions(spark, sf)).select(F.col("pos_i").alias("i"), "x", "y")
    apart = lambda t: F.round(F.sqrt(F.pow(F.col("x") - t["tx"], 2) + F.pow(F.col("y") - t["ty"], 2)), 9)
    return joins.nearest_point(spikes, targets, apart, "name").select("i", "to", *r6("distance"))


@query(
    """, g AS (SELECT (r // 11)::INT AS gy, (r % 11)::INT AS gx FROM range(121) t(r)), t AS (SELECT DISTINCT tet FROM ev
), d AS (SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) AS n FROM pos GROUP BY 1, 2), h AS (SELECT tet, floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) AS n FROM pos JOIN ev USING (i) GROUP BY 1, 2, 3
), c AS (SELECT t.tet, g.gy, g.gx, coalesce(d.n, 0)::DOUBLE AS dwell, coalesce(h.n, 0)::DOUBLE AS spk FROM t CROSS JOIN g LEFT JOIN d USING (gy, gx) LEFT JOIN h USING (tet, gy, gx)
), s AS (SELECT c.tet, c.gy, c.gx, round(sum(o.spk) / (sum(o.dwell) / 50), 9) AS rate FROM c JOIN c o ON o.tet = c.tet AND abs(o.gy - c.gy) <= 1 AND abs(o.gx - c.gx) <= 1 WHERE c.dwell > 0 GROUP BY 1, 2, 3
), b AS (SELECT tet, gy, gx, rate FROM (SELECT *, max(rate) OVER (PARTITION BY tet) AS top FROM s) WHERE rate > 0.5 * top
), co AS (SELECT tet, gy, gx, gy AS oy, gx AS ox FROM b
    UNION SELECT co.tet, co.gy, co.gx, b.gy, b.gx FROM co JOIN b ON b.tet = co.tet AND abs(b.gy - co.oy) <= 1 AND abs(b.gx - co.ox) <= 1
), ro AS (SELECT tet, gy, gx, max(oy * 100 + ox) AS root FROM co GROUP BY 1, 2, 3
), f AS (SELECT tet, root, count(*) * 100.0::DOUBLE AS area, sum(rate * (gy + 0.5)) / sum(rate) * 10 AS cy, sum(rate * (gx + 0.5)) / sum(rate) * 10 AS cx, max(rate) AS peak FROM ro JOIN b USING (tet, gy, gx) GROUP BY 1, 2
), q AS (SELECT f.*, max(b.gy * 100 + b.gx) AS at FROM f JOIN ro USING (tet, root) JOIN b ON b.tet = ro.tet AND b.gy = ro.gy AND b.gx = ro.gx AND b.rate = peak GROUP BY ALL)
SELECT tet, row_number() OVER (PARTITION BY tet ORDER BY peak DESC, q.at DESC)::INT AS label, area, round(cy, 5) AS cy, round(cx, 5) AS cx FROM q""",
    recursive=True,
)
def field_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Area and centre of each cell's fields: what is above half of a map's largest rate."""
    pos = A.positions(spark, sf)
    m = B.rate_map(pos, joins.gather(A.spikes(spark, sf), pos), SIZE, SHAPE, FS, B.boxcar(3), keys=("tet",)).where("rate is not null")
    m = m.withColumn("rate", F.round("rate", 9))  # a bin at exactly half is out, whatever the order of sums
    areas = fields.field_areas(fields.find_fields(m, ("tet",), SIZE, whole=True), ("tet",), SIZE)
    return areas.select("tet", "label", F.col("area").cast("double").alias("area"), *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("cy", "cx")])


@query()
def field_triangles(spark: SparkSession, sf: str) -> DataFrame:
    pos = A.positions(spark, sf)
    m = B.rate_map(pos, joins.gather(A.spikes(spark, sf), pos), SIZE, SHAPE, FS, None, keys=("tet",)).where("rate is not null")
    return fields.field_triangles(fields.field_areas(fields.find_fields(m, ("tet",), SIZE, least_cm2=100.0), ("tet",), SIZE), ("tet",), 30.0)


@query(
    """, a AS (SELECT i, x, y, round(avg(v) OVER (ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS rate,
       avg(k::DOUBLE) OVER (ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM pos JOIN ev USING (i)
), s AS (SELECT i, x, y, rate, CASE WHEN m < 45 THEN 0 WHEN m < 52 THEN 1 ELSE 2 END AS label FROM a
), c AS (SELECT *, sum((label IS DISTINCT FROM p)::INT) OVER (ORDER BY i) AS g FROM (SELECT *, lag(label) OVER (ORDER BY i) AS p FROM s)
), r AS (SELECT g, any_value(label) AS label, min(i) AS f, max(i) AS l, max(i) - min(i) + 1 AS n, max(rate) AS top, min(i) FILTER (WHERE rate = mx) AS peak
         FROM (SELECT *, max(rate) OVER (PARTITION BY g) AS mx FROM c WHERE label > 0) GROUP BY g HAVING max(rate) > 40
), b AS (SELECT r.g, max(s.i) FILTER (WHERE s.i >= f AND s.i < peak) AS a, min(s.i) FILTER (WHERE s.i > peak AND s.i <= l) AS b,
         max(s.i) FILTER (WHERE s.i < f) AS lft, min(s.i) FILTER (WHERE s.i >= l) AS rgt
         FROM r JOIN s ON s.i BETWEEN f - n AND l + n - 1 AND s.rate < top * 0.75 GROUP BY r.g
), w AS (SELECT r.*, coalesce(a + 1, lft + 1) AS "start", coalesce(b - 1, rgt) AS "end" FROM r JOIN b USING (g)
         WHERE (a IS NOT NULL OR f - 1 - lft < n * 0.4) AND (b IS NOT NULL OR rgt - l < n * 0.4)
), d AS (SELECT g, max(sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2))) AS width FROM w JOIN s p ON p.i BETWEEN "start" AND "end" JOIN s q ON q.i BETWEEN p.i AND "end" GROUP BY g)
SELECT row_number() OVER (ORDER BY f) AS run, label, f AS first, l AS last, peak AS i, top AS rate, "start", "end", round(width, 6) AS width FROM w JOIN d USING (g)"""
)
def run_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of a smoothed rate in runs through two regions."""
    e = A.positions(spark, sf).join(A.events(spark, sf).select("i", "v", F.col("k").cast("double").alias("k")), "i")
    mean = lambda c, r: lambda w: F.avg(c).over(w.rowsBetween(-r, r))
    s = S.framed(e, {"rate": mean("v", 4), "m": mean("k", 7)}, 7, 7).withColumn("rate", F.round("rate", 6))
    s = s.withColumn("label", F.when(F.col("m") < 45, 0).when(F.col("m") < 52, 1).otherwise(2))
    found = peaks.find_run_peaks(s, least=40.0, share=0.75, wing=0.4)
    return peaks.run_peak_widths(found, e).select("run", "label", "first", "last", "i", "rate", "start", "end", *r6("width"))


@query()
def line_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of a cell's radial autocorrelogram within two seconds."""
    spikes, pos = A.spikes(spark, sf).where(F.col("tet") == CELL), A.positions(spark, sf)
    ac = maps.windowed_autocorrelation(spikes, pos, 100, 2, 1.0, (110.0, 110.0), 1, 100, radial=True)
    rate = spikes.count() / max(1, pos.count())
    return fields.line_autocorrelation_properties(ac, rate)
