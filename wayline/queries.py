"""Registered queries over canonical tables and their DuckDB oracles; figures are rounded alike on both sides."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.circular import direction_bin
from wayline.operators import binning as B
from wayline.operators import decoding as D
from wayline.operators import detection, fields, joins, maps, resampling, tracking
from wayline.operators import sequence as S
from wayline.sources import adapters as A
from wayline.storage import materialize
from wayline.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FS, SIZE, SHAPE = A.FS, 10.0, (11, 11)
#: A cell's spikes for maps: those of one type of event.
CELL = "click"


def query(oracle: str | None = None, recursive: bool = False):
    """Registers a query; an oracle goes on from the adapters' common table expressions."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = (A.SQL.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else A.SQL) + "\n" + oracle
        return fn

    return add


def r6(*names: str) -> list:
    """Rounded columns; minus zero is zero."""
    return [(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) for n in names]


def _kin(spark: SparkSession, sf: str) -> DataFrame:
    return S.kinematics(A.positions(spark, sf), FS)


def _spike_pos(spark: SparkSession, sf: str, tet: str | None = CELL) -> DataFrame:
    spikes = A.spikes(spark, sf)
    return joins.gather(spikes.where(F.col("tet") == tet) if tet else spikes, A.positions(spark, sf))


# -- flagship ----------------------------------------------------------------


@query(
    """, z AS (SELECT i, k, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM ev
), m AS (SELECT *, z >= 0 AND NOT coalesce(lag(z >= 0) OVER (ORDER BY i), false) AS s FROM z
), l AS (SELECT *, sum(s::INT) OVER (ORDER BY i) AS label FROM m WHERE z >= 0
), isl AS (SELECT label, min(i) AS a, max(i) AS b, max(z) AS zp, max(k) AS vp FROM l GROUP BY label HAVING max(z) >= 3 AND max(k) < 95
), g AS (SELECT *, coalesce(a - lag(b) OVER (ORDER BY a) - 1 >= 4, true) AS st FROM isl
), e AS (SELECT *, sum(st::INT) OVER (ORDER BY a) AS event FROM g)
SELECT event::BIGINT AS event, min(a) AS first_i, max(b) AS last_i, count(*) AS n_islands, round(max(zp), 6) AS z_peak, max(vp)::DOUBLE AS v_peak
FROM e GROUP BY event HAVING max(b) - min(a) + 1 > 1"""
)
def events_mua(spark: SparkSession, sf: str) -> DataFrame:
    found = detection.find_events(A.events(spark, sf), speed="k", max_speed=95.0)
    return found.select("event", "first_i", "last_i", "n_islands", *r6("z_peak"), "v_peak")


# -- bins --------------------------------------------------------------------


@query(" SELECT i, floor(x / 10)::INT AS gx, floor(y / 10)::INT AS gy FROM mpos WHERE x IS NOT NULL")
def bin_xy(spark: SparkSession, sf: str) -> DataFrame:
    p = A.positions(spark, sf, masked=True).where("x is not null")
    return p.select("i", B.xy_bin(F.col("x"), SIZE).alias("gx"), B.xy_bin(F.col("y"), SIZE).alias("gy"))


@query(" SELECT i, least(greatest(floor((speed - 5) / 4) + 1, 0), 11)::INT AS b FROM kin")
def bin_speed_clip(spark: SparkSession, sf: str) -> DataFrame:
    return _kin(spark, sf).select("i", B.speed_bin(F.col("speed")).alias("b"))


@query(" SELECT i, (floor((dir + pi()) / radians(5))::INT % 72)::INT AS b FROM kin")
def bin_dir_wrap(spark: SparkSession, sf: str) -> DataFrame:
    return _kin(spark, sf).select("i", direction_bin(F.col("dir"), 5).alias("b"))


@query(" SELECT i, trunc(t_s * 50)::BIGINT AS pos_unit, trunc(t_s * 250)::BIGINT AS eeg_unit, trunc(t_s * 96000)::BIGINT AS tick FROM ev")
def spike_units(spark: SparkSession, sf: str) -> DataFrame:
    unit = lambda fs, n: (F.col("t_s") * fs).cast("long").alias(n)
    return A.events(spark, sf).select("i", unit(50, "pos_unit"), unit(250, "eeg_unit"), unit(96000, "tick"))


@query(" SELECT DISTINCT tet, cell FROM ev WHERE cell <> 0")
def cells_available(spark: SparkSession, sf: str) -> DataFrame:
    return A.spikes(spark, sf).select("tet", "cell").distinct().where("cell <> 0")


@query(" SELECT DISTINCT i // 10 AS sample, cell FROM ev")
def raster_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return A.spikes(spark, sf).select(F.expr("pos_i div 10").alias("sample"), "cell").distinct()


@query(
    """ SELECT g.gy, g.gx, coalesce(n, 0)::DOUBLE AS dwell
FROM (SELECT (r // 11)::INT AS gy, (r % 11)::INT AS gx FROM range(121) t(r)) g
LEFT JOIN (SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) AS n FROM mpos WHERE x IS NOT NULL GROUP BY ALL) d USING (gy, gx)"""
)
def dwell_map_2d(spark: SparkSession, sf: str) -> DataFrame:
    dwell = B.counted(A.positions(spark, sf, masked=True), SIZE, "dwell")
    return B.grid(spark, *SHAPE).join(dwell, ["gy", "gx"], "left").select("gy", "gx", F.coalesce("dwell", F.lit(0.0)).alias("dwell"))


# -- rate maps ---------------------------------------------------------------

_CELLS = f"""g AS (SELECT (r // 11)::INT AS gy, (r % 11)::INT AS gx FROM range(121) t(r)
), d0 AS (SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) AS dwell, count(*) FILTER (WHERE tet = '{CELL}') AS spk
          FROM pos JOIN ev USING (i) GROUP BY ALL
), c AS (SELECT g.gy, g.gx, coalesce(dwell, 0)::DOUBLE AS dwell, coalesce(spk, 0)::DOUBLE AS spk FROM g LEFT JOIN d0 USING (gy, gx))"""


def _smoothed(taps: str) -> str:
    return f""", {_CELLS}, taps AS ({taps}
), s AS (SELECT c.gy, c.gx, c.dwell > 0 AS seen, sum(n.dwell * w) AS dwell, sum(n.spk * w) AS spk
         FROM c CROSS JOIN taps JOIN c n ON n.gy = c.gy + dy AND n.gx = c.gx + dx GROUP BY c.gy, c.gx, c.dwell
)"""


_BOX = "SELECT a.k AS dy, b.k AS dx, 1 / 9.0::DOUBLE AS w FROM (SELECT unnest([-1, 0, 1]) k) a, (SELECT unnest([-1, 0, 1]) k) b"
_GAUSS = """SELECT a.k AS dy, b.k AS dx, a.w * b.w AS w
    FROM (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM range(-4, 5) t(k)) a,
         (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM range(-4, 5) t(k)) b"""


def _map(spark: SparkSession, sf: str, offsets, norm=None) -> DataFrame:
    return B.rate_map(A.positions(spark, sf), _spike_pos(spark, sf), SIZE, SHAPE, FS, offsets, norm)


@query(_smoothed(_BOX) + " SELECT gy, gx, round(CASE WHEN seen THEN spk / nullif(dwell / 50, 0) END, 6) AS rate FROM s")
def ratemap_2d_boxcar(spark: SparkSession, sf: str) -> DataFrame:
    return _map(spark, sf, B.boxcar(3)).select("gy", "gx", *r6("rate"))


@query(_smoothed(_GAUSS) + " SELECT gy, gx, round(CASE WHEN seen THEN spk / nullif(dwell / 50, 0) END, 6) AS rate FROM s")
def ratemap_2d_gauss(spark: SparkSession, sf: str) -> DataFrame:
    return _map(spark, sf, B.gaussian(1.0)).select("gy", "gx", *r6("rate"))


@query(f", {_CELLS} SELECT gy, gx, dwell, spk, round(spk / nullif(dwell, 0), 6) AS rate FROM c")
def ratemap_norm_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _map(spark, sf, B.boxcar(3), "counts").select("gy", "gx", "dwell", "spk", *r6("rate"))


_UNNORMED = _smoothed(_BOX) + ", u AS (SELECT gy, gx, CASE WHEN seen THEN spk / nullif(dwell, 0) END AS r FROM s)"


@query(_UNNORMED + " SELECT gy, gx, round(r, 6) AS rate FROM u")
def ratemap_norm_pos(spark: SparkSession, sf: str) -> DataFrame:
    return _map(spark, sf, B.boxcar(3), "pos").select("gy", "gx", *r6("rate"))


@query(
    _UNNORMED
    + """, k AS (SELECT * FROM u WHERE r IS NOT NULL)
, n AS (SELECT u.gy, u.gx, k.r, row_number() OVER (PARTITION BY u.gy, u.gx ORDER BY power(u.gy - k.gy, 2) + power(u.gx - k.gx, 2), k.gy, k.gx) AS rk FROM u, k)
SELECT gy, gx, round(r * 50, 6) AS rate FROM n WHERE rk = 1"""
)
def ratemap_nodwell_interp(spark: SparkSession, sf: str) -> DataFrame:
    return B.fill_unvisited(_map(spark, sf, B.boxcar(3)), "nearest").select("gy", "gx", *r6("rate"))


@query(
    """, m AS (SELECT i, x, y, tet, v, k FROM pos JOIN ev USING (i))
, dw AS (SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*)::DOUBLE AS dwell FROM m WHERE k < 90 GROUP BY 1, 2)
, g AS (SELECT (r // 11)::INT AS gy, (r % 11)::INT AS gx FROM range(121) t(r)), t AS (SELECT DISTINCT tet FROM m)
, c AS (SELECT tet, floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, sum(v) AS spk FROM m GROUP BY 1, 2, 3)
SELECT t.tet, g.gy, g.gx, round(coalesce(spk, 0) / dwell * 50, 6) AS rate FROM t CROSS JOIN g LEFT JOIN dw USING (gy, gx) LEFT JOIN c USING (tet, gy, gx)"""
)
def ratemap_cells_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """All cells' maps at once; spikes weighted by the signal, a part of the samples' dwell masked."""
    e = A.events(spark, sf).select("i", "k", "v")
    pos = A.positions(spark, sf).join(e, "i")
    m = B.rate_map(pos, joins.gather(A.spikes(spark, sf), pos), SIZE, SHAPE, FS, None, keys=("tet",), weight=F.col("v"), mask=F.col("k") < 90)
    return m.select("tet", "gy", "gx", *r6("rate"))


@query(
    _UNNORMED
    + """ SELECT i, round(r * 50, 6) AS rate FROM pos LEFT JOIN u ON u.gy = floor(y / 10) AND u.gx = floor(x / 10)"""
)
def rate_at_xy(spark: SparkSession, sf: str) -> DataFrame:
    return B.rate_at(A.positions(spark, sf), _map(spark, sf, B.boxcar(3)), SIZE).select("i", *r6("rate"))


@query(
    f""", g AS (SELECT (r // 11)::INT AS gy, (r % 11)::INT AS gx FROM range(121) t(r))
, d AS (SELECT gy, gx, power((gx + 0.5::DOUBLE) * 10 - x, 2) + power((gy + 0.5::DOUBLE) * 10 - y, 2) AS d2, (tet = '{CELL}')::INT AS s FROM g, pos JOIN ev USING (i))
, q AS (SELECT gy, gx, d2, count(*)::DOUBLE AS w, sum(s)::DOUBLE AS s FROM d WHERE d2 <= 225 GROUP BY 1, 2, 3)
, c AS (SELECT gy, gx, d2, sum(w) OVER o AS w, sum(s) OVER o AS s FROM q WINDOW o AS (PARTITION BY gy, gx ORDER BY d2))
, f AS (SELECT gy, gx, min(d2) AS d2, arg_min(s / w, d2) AS r FROM c WHERE d2 > 0 AND s * w * w * d2 > 2500 * 50.0::DOUBLE * 50 GROUP BY 1, 2)
SELECT gy, gx, round(r * 50, 6) AS rate, round(sqrt(d2), 6) AS radius FROM g LEFT JOIN f USING (gy, gx)"""
)
def adaptive_ratemap(spark: SparkSession, sf: str) -> DataFrame:
    m = B.adaptive_map(A.positions(spark, sf), _spike_pos(spark, sf), SIZE, SHAPE, FS)
    return m.select("gy", "gx", *r6("rate", "radius"))


@query(_UNNORMED + " SELECT gy, gx, round(r / max(r) OVER (), 6) AS rate FROM u")
def ratemap_norm_max(spark: SparkSession, sf: str) -> DataFrame:
    return _map(spark, sf, B.boxcar(3), "max").select("gy", "gx", *r6("rate"))


@query(_UNNORMED + f" SELECT gy, gx, round(r * 50 * (SELECT count(*) / 50.0::DOUBLE FROM pos) / (SELECT count(*) FROM ev WHERE tet = '{CELL}'), 6) AS rate FROM u")
def ratemap_norm_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _map(spark, sf, B.boxcar(3), "mean").select("gy", "gx", *r6("rate"))


@query(
    _UNNORMED
    + """ SELECT gy, gx, round(CASE WHEN r IS NOT NULL THEN (row_number() OVER (ORDER BY r IS NULL, round(r, 9), gy, gx) - 1) * 100.0::DOUBLE / count(r) OVER () END, 6) AS rate FROM u"""
)
def ratemap_norm_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _map(spark, sf, B.boxcar(3), "rank").select("gy", "gx", *r6("rate"))


@query(_UNNORMED + " SELECT gy, gx, round(r / (SELECT quantile_cont(r, 0.95) FROM u), 6) AS rate FROM u")
def ratemap_norm_pct(spark: SparkSession, sf: str) -> DataFrame:
    return _map(spark, sf, B.boxcar(3), 95).select("gy", "gx", *r6("rate"))


@query(
    """, d AS (SELECT floor(x / 2.5)::INT AS gx, count(*)::DOUBLE AS n FROM pos GROUP BY 1
), s AS (SELECT tet, floor(x / 2.5)::INT AS gx, count(*)::DOUBLE AS n FROM pos JOIN ev USING (i) GROUP BY 1, 2
), dw AS (SELECT d.gx, sum(e.n) / 5 / 50 AS dwell FROM d JOIN d e ON abs(d.gx - e.gx) <= 2 GROUP BY 1
), t AS (SELECT DISTINCT tet FROM s)
SELECT t.tet, dw.gx, round(dwell, 6) AS dwell, round(coalesce(sum(s.n), 0) / 5, 6) AS spk, round(coalesce(sum(s.n), 0) / 5 / dwell, 6) AS rate
FROM t CROSS JOIN dw LEFT JOIN s ON s.tet = t.tet AND abs(s.gx - dw.gx) <= 2 GROUP BY t.tet, dw.gx, dwell"""
)
def ratemap_1d(spark: SparkSession, sf: str) -> DataFrame:
    m = B.rate_map_1d(A.positions(spark, sf), _spike_pos(spark, sf, None), 2.5, FS, keys=("tet",))
    return m.select("tet", "gx", *r6("dwell", "spk", "rate"))


_DIR = f""", h AS (SELECT (floor((dir + pi()) / radians(5))::INT % 72) AS b, count(*) AS dw, count(*) FILTER (WHERE tet = '{CELL}') AS sp
         FROM kin JOIN ev USING (i) WHERE speed > 5 GROUP BY 1
), c AS (SELECT r::INT AS b, coalesce(dw, 0) AS dw, coalesce(sp, 0) AS sp FROM range(72) t(r) LEFT JOIN h ON h.b = r
), dm AS (SELECT c.b, sum(n.dw) / 5.0::DOUBLE / 50 AS dwell, sum(n.sp) / 5.0::DOUBLE AS spk FROM c JOIN c n ON (n.b - c.b + 72 + 2) % 72 <= 4 GROUP BY 1)"""


def _dir_map(spark: SparkSession, sf: str) -> DataFrame:
    kin = _kin(spark, sf)
    return B.direction_map(kin, joins.gather(A.spikes(spark, sf).where(F.col("tet") == CELL), kin), FS)


@query(_DIR + " SELECT b, round(dwell, 6) AS dwell, round(spk, 6) AS spk, round(spk / nullif(dwell, 0), 6) AS rate FROM dm")
def ratemap_dir(spark: SparkSession, sf: str) -> DataFrame:
    return _dir_map(spark, sf).select("b", *r6("dwell", "spk", "rate"))


@query(
    _DIR
    + """, t AS (SELECT spk / nullif(dwell, 0) AS r, b * radians(5) - pi() AS th FROM dm)
SELECT round(sqrt(power(sum(r * cos(th)), 2) + power(sum(r * sin(th)), 2)) / sum(r) * (radians(2.5) / sin(radians(2.5))), 6) AS r FROM t"""
)
def dir_r(spark: SparkSession, sf: str) -> DataFrame:
    return B.resultant(_dir_map(spark, sf)).select(*r6("r"))


@query(" SELECT least(greatest(floor((speed - 5) / 4) + 1, 0), 11)::INT AS b, count(*) AS n FROM kin GROUP BY 1")
def speed_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _kin(spark, sf).groupBy(B.speed_bin(F.col("speed")).alias("b")).agg(F.count("*").alias("n"))


@query(" SELECT tet, floor(t_s / 600)::BIGINT AS b, count(*) AS n FROM ev GROUP BY 1, 2")
def mua_hist(spark: SparkSession, sf: str) -> DataFrame:
    return A.spikes(spark, sf).groupBy("tet", F.floor(F.col("t_s") / 600).alias("b")).agg(F.count("*").alias("n"))


@query(
    f""", n AS (SELECT count(*) AS n FROM ev), c AS (SELECT i, (tet = '{CELL}')::INT * 50.0::DOUBLE AS c FROM ev
), taps AS (SELECT k, exp(-0.5 * k * k / 4.0) / sum(exp(-0.5 * k * k / 4.0)) OVER () AS w FROM range(-8, 9) t(k)
), x AS (SELECT c.i, w, CASE WHEN c.i + k < 0 THEN -1 - c.i - k WHEN c.i + k >= n THEN 2 * n - 1 - c.i - k ELSE c.i + k END AS j FROM c, taps, n)
SELECT x.i, round(sum(w * c.c), 6) AS rate FROM x JOIN c ON c.i = x.j GROUP BY x.i"""
)
def rate_series(spark: SparkSession, sf: str) -> DataFrame:
    hits = A.events(spark, sf).select("i", ((F.col("tet") == CELL).cast("int") * FS).alias("c"))
    return S.smooth(hits, "c", B.gaussian_taps(2.0), "rate").select("i", *r6("rate"))


# -- sequences ---------------------------------------------------------------


@query(" SELECT i, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS z FROM ev")
def zscore_series(spark: SparkSession, sf: str) -> DataFrame:
    return S.zscore(A.events(spark, sf), "v").select("i", *r6("z"))


_ISL = """, m AS (SELECT i, v >= 50 AS m, v >= 50 AND NOT coalesce(lag(v >= 50) OVER (ORDER BY i), false) AS s FROM ev
), l AS (SELECT i, CASE WHEN m THEN sum(s::INT) OVER (ORDER BY i) ELSE 0 END::BIGINT AS label FROM m)"""


@query(_ISL + " SELECT i, label FROM l")
def islands(spark: SparkSession, sf: str) -> DataFrame:
    return S.islands(A.events(spark, sf), F.col("v") >= 50).select("i", "label")


@query(
    _ISL
    + """, p AS (SELECT label, min(i) AS a, max(i) AS b FROM l WHERE label > 0 GROUP BY 1
), q AS (SELECT *, coalesce(a - lag(b) OVER (ORDER BY a) - 1 >= 3, true) AS st FROM p), g AS (SELECT *, sum(st::INT) OVER (ORDER BY a) AS e FROM q)
SELECT e::BIGINT AS event, min(a) AS first_i, max(b) AS last_i FROM g GROUP BY 1"""
)
def islands_closed(spark: SparkSession, sf: str) -> DataFrame:
    spans = S.islands(A.events(spark, sf), F.col("v") >= 50).where("label > 0").groupBy("label").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"))
    return S.close_gaps(spans, 3).groupBy("event").agg(F.min("first_i").alias("first_i"), F.max("last_i").alias("last_i"))


@query(
    """, a AS (SELECT i, x, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i) AS ia,
                 last_value(x IGNORE NULLS) OVER (ORDER BY i) AS xa,
                 first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib,
                 first_value(x IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xb FROM mpos)
SELECT i, round(coalesce(x, xa + (xb - xa) * ((i - ia) / nullif(ib - ia, 0)::DOUBLE), xa, xb), 6) AS x FROM a"""
)
def interp_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return S.interpolate(A.positions(spark, sf, masked=True), "x", "x2").select("i", F.col("x2").alias("x")).select("i", *r6("x"))


@query(" SELECT i, max(v > 150) OVER (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS bad FROM ev")
def running_max_mask(spark: SparkSession, sf: str) -> DataFrame:
    e = A.events(spark, sf)
    return S.framed(e, {"bad": lambda w: F.max(F.col("v") > 150).over(w.rowsBetween(-5, 5))}, 5, 5).select("i", "bad")


@query(_ISL + " SELECT i, round(CASE WHEN label > 0 THEN sum(v) OVER (PARTITION BY label ORDER BY i) END, 6) AS c FROM l JOIN ev USING (i)")
def segmented_cumsum(spark: SparkSession, sf: str) -> DataFrame:
    runs = S.islands(A.events(spark, sf), F.col("v") >= 50)
    return S.segmented_sum(runs, F.col("v"), "label", "c").select("i", *r6("c"))


@query(
    """, d AS (SELECT i, coalesce(sqrt(power(x - lag(x) OVER (ORDER BY i), 2) + power(y - lag(y) OVER (ORDER BY i), 2)), 0) AS d FROM pos)
SELECT i, round(sum(d) OVER (ORDER BY i), 2) AS path FROM d"""
)
def path_len_cum(spark: SparkSession, sf: str) -> DataFrame:
    return S.path_length(A.positions(spark, sf)).select("i", (F.round("path", 2) + 0.0).alias("path"))


@query(" SELECT i, v FROM (SELECT i, v, lag(v) OVER (ORDER BY i) AS a, lead(v) OVER (ORDER BY i) AS b FROM ev) WHERE v > a AND v > b")
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return S.local_maxima(A.events(spark, sf), "v").select("i", "v")


@query(" SELECT i, round(i + (50 - v) / (b - v), 6) AS at FROM (SELECT i, v, lead(v) OVER (ORDER BY i) AS b FROM ev) WHERE v <= 50 AND b > 50")
def threshold_cross(spark: SparkSession, sf: str) -> DataFrame:
    return S.crossings(A.events(spark, sf), "v", 50.0).select("i", *r6("at"))


# -- joins -------------------------------------------------------------------


@query(" SELECT tet, cell, i AS pos_i, round(speed, 6) AS speed FROM ev JOIN kin USING (i) WHERE speed > 10")
def gather_speed_at_spike(spark: SparkSession, sf: str) -> DataFrame:
    at = joins.gather(A.spikes(spark, sf), _kin(spark, sf)).where("speed > 10")
    return at.select("tet", "cell", "pos_i", *r6("speed"))


_EVENTS = ORACLES["events_mua"].removeprefix(A.SQL)
_EVENTS = _EVENTS[: _EVENTS.index("SELECT event::BIGINT")] + """, me AS (
    SELECT event::BIGINT AS event, min(a) AS fi, max(b) AS li FROM e GROUP BY event HAVING max(b) - min(a) + 1 > 1
), span AS (SELECT event, p.t_s AS ta, q.t_s AS tb FROM me JOIN ev p ON p.i = fi JOIN ev q ON q.i = li
), es AS (SELECT event, tet, cell, t_s FROM span JOIN ev ON t_s BETWEEN ta AND tb)"""


def _event_spans(spark: SparkSession, sf: str) -> DataFrame:
    """``event, ta, tb`` of the flagship's events."""
    e = A.events(spark, sf)
    found = detection.find_events(e, speed="k", max_speed=95.0)
    times = e.select(F.col("i").alias("first_i"), F.col("t_s").alias("ta")), e.select(F.col("i").alias("last_i"), F.col("t_s").alias("tb"))
    return found.select("event", "first_i", "last_i").join(times[0], "first_i").join(times[1], "last_i").select("event", "ta", "tb")


def _event_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return joins.interval_join(A.spikes(spark, sf), _event_spans(spark, sf), "t_s", "ta", "tb", 3600.0)


@query(_EVENTS + " SELECT event, tet, cell, round(t_s, 6) AS t_s FROM es")
def event_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return _event_spikes(spark, sf).select("event", "tet", "cell", *r6("t_s"))


@query(_EVENTS + " SELECT event, count(*) AS n_spikes, count(DISTINCT (tet, cell)) AS n_cells FROM es GROUP BY event")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _event_spikes(spark, sf).groupBy("event").agg(F.count("*").alias("n_spikes"), F.count_distinct("tet", "cell").alias("n_cells"))


@query(_EVENTS + " SELECT event, count(*) AS n_spikes FROM es GROUP BY event ORDER BY n_spikes DESC, event LIMIT 1")
def event_top1(spark: SparkSession, sf: str) -> DataFrame:
    return _event_spikes(spark, sf).groupBy("event").agg(F.count("*").alias("n_spikes")).orderBy(F.desc("n_spikes"), "event").limit(1)


@query(_EVENTS + " SELECT event, cell, floor(round(t_s - ta, 6) / 60)::BIGINT AS b, count(*) AS n FROM es JOIN span USING (event) GROUP BY 1, 2, 3")
def event_raster(spark: SparkSession, sf: str) -> DataFrame:
    s = _event_spikes(spark, sf)
    return s.groupBy("event", "cell", F.floor(F.round(F.col("t_s") - F.col("ta"), 6) / 60).alias("b")).agg(F.count("*").alias("n"))


_LAGS = """, sp AS (SELECT tet, cell, i, t_s FROM ev
), pr AS (SELECT a.tet, a.cell, a.i AS ia, b.i AS ib, b.t_s - a.t_s AS lag FROM sp a JOIN sp b USING (tet, cell) WHERE b.i >= a.i AND b.t_s - a.t_s < 7200)"""


@query(_LAGS + " SELECT tet, floor(lag / 360)::BIGINT AS b, count(*) AS n FROM pr GROUP BY 1, 2")
def acg(spark: SparkSession, sf: str) -> DataFrame:
    pairs = joins.lag_pairs(A.spikes(spark, sf), 7200.0)
    return pairs.groupBy("tet", F.floor(F.col("lag") / 360).alias("b")).agg(F.count("*").alias("n"))


@query(_LAGS + " SELECT tet, cell, floor(lag / 600)::BIGINT AS b, count(*) AS n FROM pr WHERE ib > ia GROUP BY 1, 2, 3")
def lag_hist_forward(spark: SparkSession, sf: str) -> DataFrame:
    pairs = joins.lag_pairs(A.spikes(spark, sf), 7200.0).where("ib > ia")
    return pairs.groupBy("tet", "cell", F.floor(F.col("lag") / 600).alias("b")).agg(F.count("*").alias("n"))


@query(_LAGS + " SELECT i, count(*) AS n FROM (SELECT ia AS i FROM pr WHERE lag > 600 AND lag <= 3600 UNION ALL SELECT ib FROM pr WHERE lag > 600 AND lag <= 3600) GROUP BY 1")
def adjacent_spikes(spark: SparkSession, sf: str) -> DataFrame:
    pairs = joins.lag_pairs(A.spikes(spark, sf), 7200.0).where("lag > 600 and lag <= 3600")
    return pairs.select(F.explode(F.array("ia", "ib")).alias("i")).groupBy("i").agg(F.count("*").alias("n"))


@query(
    """, grid AS (SELECT (unnest(range(a, b + 1)) * 500)::DOUBLE AS t_s FROM (SELECT ceil(min(t_s) / 500)::BIGINT AS a, floor(max(t_s) / 500)::BIGINT AS b FROM ev)
), a AS (SELECT g.t_s, p.t_s AS ta, p.v AS va FROM grid g ASOF LEFT JOIN ev p ON g.t_s >= p.t_s
), b AS (SELECT g.t_s, p.t_s AS tb, p.v AS vb FROM grid g ASOF LEFT JOIN ev p ON g.t_s <= p.t_s)
SELECT t_s, round(va + (vb - va) * coalesce((t_s - ta) / nullif(tb - ta, 0), 0), 6) AS v FROM a JOIN b USING (t_s)"""
)
def asof_speed(spark: SparkSession, sf: str) -> DataFrame:
    """The signal every 500 s, from the series' first time to its last."""
    e = A.events(spark, sf)
    span = e.agg(F.ceil(F.min("t_s") / 500).alias("a"), F.floor(F.max("t_s") / 500).alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b")).alias("k")).select((F.col("k") * 500).cast("double").alias("t_s"))
    return joins.as_of_linear(grid, e, "v", "v").select("t_s", *r6("v"))


_TRACK = [(0, 0.0, 0.0, 100.0, 0.0, 0.0), (1, 100.0, 0.0, 0.0, 99.0, 100.0), (2, 0.0, 99.0, 100.0, 99.0, 240.7)]
_EDGES = ", edge(e, ax, ay, gx, gy, base) AS (VALUES " + ", ".join(str(x) for x in _TRACK) + ")"


@query(
    _EDGES
    + """, p AS (SELECT i, e, base, ax, ay, gx - ax AS ux, gy - ay AS uy, x, y,
                 least(greatest(((x - ax) * (gx - ax) + (y - ay) * (gy - ay)) / (power(gx - ax, 2) + power(gy - ay, 2)), 0), 1)::DOUBLE AS f FROM pos, edge
), q AS (SELECT i, e, base + f * sqrt(ux * ux + uy * uy) AS lin, sqrt(power(x - ax - f * ux, 2) + power(y - ay - f * uy, 2)) AS d FROM p)
SELECT i, e AS edge, round(lin, 6) AS linear FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), e) AS r FROM q) WHERE r = 1"""
)
def linearize_track(spark: SparkSession, sf: str) -> DataFrame:
    edges = [tracking.Edge(*e) for e in _TRACK]
    at = A.positions(spark, sf).select("i", tracking.nearest_edge(F.col("x"), F.col("y"), edges).alias("s"))
    return at.select("i", "s.edge", "s.linear").select("i", "edge", *r6("linear"))


# -- behaviour and maps ------------------------------------------------------


@query(
    """ SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) AS n,
       round(1 - sqrt(power(avg(cos(dir)), 2) + power(avg(sin(dir)), 2)), 6) AS variance FROM kin GROUP BY 1, 2"""
)
def dir_variance_map(spark: SparkSession, sf: str) -> DataFrame:
    binned = _kin(spark, sf).withColumns({"gy": B.xy_bin(F.col("y"), SIZE), "gx": B.xy_bin(F.col("x"), SIZE)})
    return D.direction_mean(binned, F.col("dir"), ["gy", "gx"]).select("gy", "gx", "n", *r6("variance"))


@query(
    """ SELECT round(avg(speed), 6) AS mean_speed, round(quantile_cont(speed, 0.25), 6) AS q1, round(quantile_cont(speed, 0.75), 6) AS q3,
       round(avg((speed > 1000)::INT), 6) AS active FROM kin"""
)
def behaviour_props(spark: SparkSession, sf: str) -> DataFrame:
    k = _kin(spark, sf)
    q1, q3 = S.percentiles(k, "speed", [0.25, 0.75])
    props = k.agg(F.avg("speed").alias("mean_speed"), F.lit(q1).alias("q1"), F.lit(q3).alias("q3"), F.avg((F.col("speed") > 1000).cast("int")).alias("active"))
    return props.select(*r6("mean_speed", "q1", "q3", "active"))


@query(" SELECT quantile_cont(x, 0.02) AS x_low, quantile_cont(x, 0.98) AS x_high, quantile_cont(y, 0.02) AS y_low, quantile_cont(y, 0.98) AS y_high FROM mpos")
def rect_fit(spark: SparkSession, sf: str) -> DataFrame:
    p = A.positions(spark, sf, masked=True)
    found = (*S.percentiles(p, "x", [0.02, 0.98]), *S.percentiles(p, "y", [0.02, 0.98]))
    return spark.createDataFrame([found], "x_low double, x_high double, y_low double, y_high double")


_RATE = _smoothed(_BOX) + ", rm AS (SELECT gy, gx, CASE WHEN seen THEN spk / nullif(dwell / 50, 0) END AS r FROM s)"
_R = """round(greatest(least((n * sab - sa * sb) / nullif(sqrt(greatest(n * saa - sa * sa, 0)) * sqrt(greatest(n * sbb - sb * sb, 0)), 0), 1), -1), 6)"""
_SUMS = "count(*)::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab"


@query(
    _RATE
    + """, pr AS (SELECT q.gy - p.gy AS dy, q.gx - p.gx AS dx, p.r AS a, q.r AS b FROM rm p, rm q WHERE p.r IS NOT NULL AND q.r IS NOT NULL
), m AS (SELECT dy, dx, count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, corr(a, b) AS r FROM pr GROUP BY 1, 2), u AS (SELECT var_pop(r) AS v FROM rm)
SELECT dy::INT AS dy, dx::INT AS dx, n, round(CASE WHEN n * va > 1e-10 * v AND n * vb > 1e-10 * v THEN greatest(least(r, 1), -1) END, 6) AS r FROM m, u WHERE n > 1"""
)
def spatial_ac(spark: SparkSession, sf: str) -> DataFrame:
    return maps.autocorrelation(_map(spark, sf, B.boxcar(3))).select("dy", "dx", "n", *r6("r"))


@query(
    f""", {_CELLS}, q AS (SELECT gy, gx, least(spk, 3) AS v FROM c)
SELECT q.gy, q.gx, coalesce(bool_or(p.v <> q.v), false) AS boundary FROM q LEFT JOIN q p ON abs(p.gy - q.gy) + abs(p.gx - q.gx) = 1 GROUP BY 1, 2"""
)
def boundary_mask(spark: SparkSession, sf: str) -> DataFrame:
    m = _map(spark, sf, None, "counts").select("gy", "gx", F.least("spk", F.lit(3.0)).alias("v"))
    return maps.boundaries(m, "v").select("gy", "gx", "boundary")


@query(
    _RATE
    + """, kn AS (SELECT * FROM rm WHERE r IS NOT NULL)
, pr AS (SELECT p.gy, p.gx, p.r, q.r AS b, (p.gy - q.gy) AS dy, (p.gx - q.gx) AS dx, 100.0::DOUBLE * (power(p.gy - q.gy, 2) + power(p.gx - q.gx, 2)) AS d2
         FROM kn p JOIN kn q ON abs(p.gy - q.gy) <= 2 AND abs(p.gx - q.gx) <= 2 AND (p.gy, p.gx) <> (q.gy, q.gx))
SELECT gy, gx, round(r * sum(b / d2), 5) AS simple, round(r * sum(b * dy * power(d2, -1.5)), 5) AS fy, round(r * sum(b * dx * power(d2, -1.5)), 5) AS fx FROM pr GROUP BY gy, gx, r"""
)
def gravity(spark: SparkSession, sf: str) -> DataFrame:
    g = maps.gravity(_map(spark, sf, B.boxcar(3)), SIZE)
    return g.select("gy", "gx", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("simple", "fy", "fx")])


def _half(spark: SparkSession, sf: str, odd: bool) -> DataFrame:
    part = (F.expr("i div 100") % 2) == int(odd)
    pos = A.positions(spark, sf).where(part)
    spk = joins.gather(A.spikes(spark, sf).where(F.col("tet") == CELL), pos)
    return B.rate_map(pos, spk, SIZE, SHAPE, FS, None)


@query(
    f""", h AS (SELECT (i // 100) % 2 AS odd, floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) FILTER (WHERE tet = '{CELL}') * 50.0::DOUBLE / count(*) AS r
         FROM pos JOIN ev USING (i) GROUP BY ALL
), pr AS (SELECT p.r AS a, q.r AS b FROM h p JOIN h q USING (gy, gx) WHERE p.odd = 0 AND q.odd = 1), m AS (SELECT {_SUMS} FROM pr)
SELECT n::BIGINT AS n, {_R} AS r FROM m"""
)
def stability_half(spark: SparkSession, sf: str) -> DataFrame:
    return maps.stability(_half(spark, sf, False), _half(spark, sf, True)).select("n", *r6("r"))


@query(
    _RATE
    + f""", nb AS (SELECT p.r AS a, avg(q.r) AS b FROM rm p JOIN rm q ON abs(p.gy - q.gy) <= 1 AND abs(p.gx - q.gx) <= 1 AND (p.gy, p.gx) <> (q.gy, q.gx)
         WHERE p.r IS NOT NULL AND q.r IS NOT NULL GROUP BY p.gy, p.gx, p.r), m AS (SELECT {_SUMS} FROM nb)
SELECT n::BIGINT AS n, {_R} AS r FROM m"""
)
def coherence(spark: SparkSession, sf: str) -> DataFrame:
    return maps.coherence(_map(spark, sf, B.boxcar(3))).select("n", *r6("r"))


@query(
    f""", {_CELLS} SELECT p.gy, p.gx, p.spk AS rate FROM c p JOIN c q ON abs(p.gy - q.gy) <= 1 AND abs(p.gx - q.gx) <= 1
GROUP BY p.gy, p.gx, p.spk HAVING p.spk > 0 AND p.spk = max(q.spk)"""
)
def regional_max(spark: SparkSession, sf: str) -> DataFrame:
    return maps.regional_maxima(_map(spark, sf, None, "counts").select("gy", "gx", F.col("spk").alias("rate")))


@query(f", {_CELLS} SELECT gy // 4 AS label, round(sum(spk * gx) / nullif(sum(spk), 0), 6) AS cx, round(sum(spk * gy) / nullif(sum(spk), 0), 6) AS cy FROM c GROUP BY 1")
def field_centroid(spark: SparkSession, sf: str) -> DataFrame:
    m = _map(spark, sf, None, "counts").select("gy", "gx", F.col("spk").alias("rate"), F.expr("gy div 4").cast("int").alias("label"))
    return maps.centroids(m, "label").select("label", *r6("cx", "cy"))


@query(
    f""", {_CELLS}, w AS (SELECT gy * 11 + gx AS id, spk AS wt FROM c
), o AS (SELECT *, coalesce(sum(wt) OVER (ORDER BY wt DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(wt) OVER () AS total FROM w)
SELECT id::INT AS id, wt FROM o WHERE before <= 0.95 * total"""
)
def topk_weight_cut(spark: SparkSession, sf: str) -> DataFrame:
    m = _map(spark, sf, None, "counts").select((F.col("gy") * 11 + F.col("gx")).alias("id"), F.col("spk").alias("wt"))
    return maps.weight_cut(m, "wt")


@query(" SELECT cell, count(*) AS n, round(atan2(avg(sin(radians(3.6 * k))), avg(cos(radians(3.6 * k)))), 6) AS mean FROM ev GROUP BY 1")
def circ_mean(spark: SparkSession, sf: str) -> DataFrame:
    return D.direction_mean(A.events(spark, sf), F.col("k") * math.radians(3.6), ["cell"]).select("cell", "n", *r6("mean"))


@query(
    """, c AS (SELECT cell, count(*) FILTER (WHERE v > 50 AND k <= 50) AS b, count(*) FILTER (WHERE v <= 50 AND k > 50) AS c FROM ev GROUP BY cell
), bi AS (SELECT cell, b, b + c AS n, sum(CASE WHEN k <= b THEN exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1)) END) / power(2, b + c) AS f
          FROM c, range(25) t(k) WHERE b + c < 25 AND k <= b + c GROUP BY 1, 2, 3
), no AS (SELECT cell, sum(exp(-0.5 * power(z + (k + 0.5) * (12 - z) / 4000, 2)) * (12 - z)) / 4000 * 2 / sqrt(2 * pi()) AS p
          FROM (SELECT cell, least(abs(b - c) / sqrt((b + c)::DOUBLE), 11.9) AS z FROM c WHERE b + c >= 25), range(4000) t(k) GROUP BY cell)
SELECT c.cell, c.b, c.c, round(CASE WHEN c.b + c.c >= 25 THEN power(c.b - c.c, 2) / (c.b + c.c)::DOUBLE END, 6) AS chi2, round(coalesce(no.p, CASE WHEN f < 0.5 THEN 2 * f ELSE 2 * (1 - f) END), 4) AS p
FROM c LEFT JOIN bi USING (cell) LEFT JOIN no USING (cell)"""
)
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    one, two = F.col("v") > 50, F.col("k") > 50
    n = A.events(spark, sf).groupBy("cell").agg(F.count_if(one & ~two).alias("b"), F.count_if(~one & two).alias("c"))
    return resampling.mcnemar(n).select("cell", "b", "c", *r6("chi2"), (F.round("p", 4) + F.lit(0.0)).alias("p"))


# -- decoding ----------------------------------------------------------------


@query(
    """, st AS (SELECT i, floor(x / 10)::INT AS s FROM pos), p AS (SELECT lag(s) OVER (ORDER BY i) AS a, s AS b FROM st
), n AS (SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY 1, 2
), g AS (SELECT (r // 11)::INT AS a, (r % 11)::INT AS b FROM range(121) t(r)), d AS (SELECT g.a, g.b, coalesce(n, 0) + 0.5::DOUBLE AS n FROM g LEFT JOIN n USING (a, b))
SELECT a, b, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM d"""
)
def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    states = A.positions(spark, sf).select("i", B.xy_bin(F.col("x"), SIZE).alias("s"))
    return D.transitions(states, 11, 0.5).select("a", "b", *r6("p"))


_LL = """, f AS (SELECT tet, floor(x / 10)::INT AS gx, count(*) AS n FROM pos JOIN ev USING (i) GROUP BY 1, 2
), dw AS (SELECT floor(x / 10)::INT AS gx, count(*) AS dwell FROM pos GROUP BY 1
), fi AS (SELECT tet, gx, (n + 0.1::DOUBLE) / dwell AS rate FROM f JOIN dw USING (gx)
), ct AS (SELECT i // 20 AS t, tet, count(*) AS n FROM ev GROUP BY 1, 2
), sl AS (SELECT gx, -sum(rate) * 20 AS silent FROM fi GROUP BY 1
), ll AS (SELECT t, gx, sum(ct.n * ln(rate * 20)) + any_value(silent) AS ll FROM ct JOIN fi USING (tet) JOIN sl USING (gx) GROUP BY 1, 2)"""


def _likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    dwell = A.positions(spark, sf).groupBy(B.xy_bin(F.col("x"), SIZE).alias("gx")).agg(F.count("*").alias("dwell"))
    spk = _spike_pos(spark, sf, None).groupBy(F.col("tet").alias("cell"), B.xy_bin(F.col("x"), SIZE).alias("gx")).agg(F.count("*").alias("n"))
    fields = spk.join(F.broadcast(dwell), "gx").select("cell", "gx", ((F.col("n") + 0.1) / F.col("dwell")).alias("rate"))
    counts = A.spikes(spark, sf).groupBy(F.expr("pos_i div 20").alias("t"), F.col("tet").alias("cell")).agg(F.count("*").alias("n"))
    return D.log_likelihood(counts, fields, 20.0)


@query(_LL + " SELECT t, gx, round(ll, 5) AS ll FROM ll")
def poisson_loglik(spark: SparkSession, sf: str) -> DataFrame:
    return _likelihoods(spark, sf).select("t", "gx", (F.round("ll", 5) + 0.0).alias("ll"))


_MAP = _LL + ", md AS (SELECT t, gx FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(ll, 9) DESC, gx) AS r FROM ll) WHERE r = 1)"


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    return D.map_decode(_likelihoods(spark, sf).withColumn("ll", F.round("ll", 9)))


@query(_MAP + " SELECT t, gx FROM md")
def map_decode(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf)


@query(_MAP + ", tr AS (SELECT i // 20 AS t, floor(x / 10)::INT AS gx FROM pos WHERE i % 20 = 0) SELECT count(*) AS n, quantile_cont(abs(md.gx - tr.gx)::DOUBLE, 0.5) AS median_error FROM md JOIN tr USING (t)")
def median_decode_error(spark: SparkSession, sf: str) -> DataFrame:
    truth = A.positions(spark, sf).where("i % 20 = 0").select(F.expr("i div 20").alias("t"), B.xy_bin(F.col("x"), SIZE).alias("gx"))
    return D.median_error(_decoded(spark, sf), truth)


def _moves() -> list[list[float]]:
    moves = [[(0.8 if a == b else 0.1 if abs(a - b) == 1 else 0.0) + 0.01 for b in range(11)] for a in range(11)]
    return [[x / sum(row) for x in row] for row in moves]


_FILTER = (
    _LL
    + f""", mv AS (SELECT {_moves()}::DOUBLE[][] AS m), lt AS (SELECT t, list(exp(ll - mx) ORDER BY gx) AS l FROM (SELECT *, max(ll) OVER (PARTITION BY t) AS mx FROM ll) GROUP BY t
), cf AS (SELECT t, list_transform(l, lambda x: x / list_sum(l)) AS p FROM lt WHERE t = 0
    UNION ALL SELECT t, list_transform(q, lambda x: x / list_sum(q)) FROM (
        SELECT lt.t, list_transform(range(1, 12), lambda b: l[b] * list_sum(list_transform(range(1, 12), lambda a: p[a] * m[a][b]))) AS q FROM cf JOIN lt ON lt.t = cf.t + 1, mv)
)"""
)


def _causal(spark: SparkSession, sf: str) -> DataFrame:
    """All time bins as one session."""
    ll = _likelihoods(spark, sf).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("gx", "ll"))).alias("s"))
    rows = ll.select(F.lit(1).alias("session"), "t", F.transform("s", lambda x: x["ll"]).alias("l"))
    return D.forward_filter(rows, _moves())


def _by_bin(posterior: DataFrame) -> DataFrame:
    return posterior.select("t", F.posexplode("p").alias("gx", "p")).select("t", "gx", *r6("p"))


@query(_FILTER + " SELECT t, unnest(range(0, 11))::INT AS gx, round(unnest(p), 6) AS p FROM cf", recursive=True)
def forward_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _by_bin(_causal(spark, sf))


@query(
    _FILTER
    + """, z AS (SELECT t, p FROM cf WHERE t = (SELECT max(t) FROM cf)
    UNION ALL SELECT t, list_transform(q, lambda x: x / list_sum(q)) FROM (
        SELECT cf.t, list_transform(range(1, 12), lambda a: cf.p[a] * list_sum(list_transform(range(1, 12), lambda b: m[a][b] * z.p[b]
            / list_sum(list_transform(range(1, 12), lambda c: cf.p[c] * m[c][b]))))) AS q FROM z JOIN cf ON cf.t = z.t - 1, mv)
) SELECT t, unnest(range(0, 11))::INT AS gx, round(unnest(p), 6) AS p FROM z""",
    recursive=True,
)
def acausal_posterior(spark: SparkSession, sf: str) -> DataFrame:
    return _by_bin(D.backward_smoother(_causal(spark, sf), _moves()))


@query(
    """, b AS (SELECT (r)::INT AS gx, 5 + 10 * r AS c FROM range(10) t(r)), q AS (SELECT i, tet, round(x / 0.1) * 0.1 AS x FROM pos JOIN ev USING (i))
, d AS (SELECT gx, sum(exp(-0.5 * power((x - c) / 3, 2))) AS w FROM q, b GROUP BY 1), s AS (SELECT tet AS cell, gx, sum(exp(-0.5 * power((x - c) / 3, 2))) AS n FROM q, b GROUP BY 1, 2)
SELECT cell, gx, round(n * 50 / w, 6) AS rate FROM s JOIN d USING (gx)"""
)
def place_fields_kde(spark: SparkSession, sf: str) -> DataFrame:
    spk = _spike_pos(spark, sf, None).withColumn("cell", F.col("tet"))
    return D.kernel_fields(spk, A.positions(spark, sf), D.place_bins(spark, 0.0, 100.0, 100.0), FS).select("cell", "gx", *r6("rate"))


# -- sessions ----------------------------------------------------------------


@query(
    """, r AS (SELECT i, cell, t_s AS end_s FROM ev WHERE tet = 'purchase'
), o AS (SELECT *, lag(end_s) OVER (PARTITION BY cell ORDER BY i) AS p FROM r)
SELECT i, cell, round(coalesce(p, 0), 6) AS start_s, round(end_s, 6) AS end_s, round(end_s - coalesce(p, 0), 6) AS duration_s FROM o"""
)
def vr_trial_epochs(spark: SparkSession, sf: str) -> DataFrame:
    rewards = A.events(spark, sf).where("tet = 'purchase'").select("i", "cell", F.col("t_s").alias("end_s"))
    trials = S.previous(rewards, F.col("end_s"), "start_s", keys=("cell",)).withColumn("start_s", F.coalesce("start_s", F.lit(0.0)))
    return trials.withColumn("duration_s", F.col("end_s") - F.col("start_s")).select("i", "cell", *r6("start_s", "end_s", "duration_s"))


# -- tracking, fits and streams ------------------------------------------------


@query(
    """, m AS (SELECT cell, avg(x) AS mx, avg(y) AS my FROM pos JOIN ev USING (i) GROUP BY 1
), c AS (SELECT cell, mx, my, x - mx AS u, y - my AS v FROM pos JOIN ev USING (i) JOIN m USING (cell)
), s AS (SELECT cell, mx, my, count(*)::DOUBLE AS n, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv,
                sum(u * u * u + u * v * v) AS p, sum(v * v * v + v * u * u) AS q FROM c GROUP BY 1, 2, 3
), f AS (SELECT *, (p * vv - q * uv) / nullif(2 * (uu * vv - uv * uv), 0) AS a, (q * uu - p * uv) / nullif(2 * (uu * vv - uv * uv), 0) AS b FROM s)
SELECT cell, n::BIGINT AS n, round(mx + a, 4) AS cx, round(my + b, 4) AS cy, round(sqrt(a * a + b * b + (uu + vv) / n), 4) AS r FROM f WHERE n > 4"""
)
def circle_fit(spark: SparkSession, sf: str) -> DataFrame:
    at = A.positions(spark, sf).join(A.events(spark, sf).select("i", "cell"), "i")
    fit = tracking.fit_circle(at, ("cell",)).where("n > 4")
    return fit.select("cell", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("cx", "cy", "r")])


@query(
    """, tr AS (SELECT cell, i, x, y, row_number() OVER (PARTITION BY cell ORDER BY i) AS r FROM mpos JOIN ev USING (i)
), jf AS (SELECT cell, i, r, x IS NOT NULL AS ok, CASE WHEN x IS NOT NULL THEN i END AS li, x AS lx, y AS ly FROM tr WHERE r = 1
    UNION ALL SELECT cell, i, r, g, CASE WHEN g THEN i ELSE li END, CASE WHEN g THEN x ELSE lx END, CASE WHEN g THEN y ELSE ly END FROM (
        SELECT tr.*, li, lx, ly, tr.x IS NOT NULL AND (li IS NULL OR power(tr.x - lx, 2) + power(tr.y - ly, 2) <= power((tr.i - li) * 2.0, 2)) AS g
        FROM jf JOIN tr ON tr.cell = jf.cell AND tr.r = jf.r + 1)
) SELECT cell, i, ok FROM jf""",
    recursive=True,
)
def jump_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Each cell's events as a track of its own."""
    at = A.positions(spark, sf, masked=True).join(A.events(spark, sf).select("i", "cell"), "i")
    return tracking.jump_filter(at, 2.0, ("cell",))


@query(
    """, b AS (SELECT least(greatest(floor((speed - 5) / 400) + 1, 0), 11) AS b, avg(v) AS m FROM kin JOIN ev USING (i) GROUP BY 1)
SELECT count(*) AS n, round(regr_slope(m, b), 6) AS slope, round(regr_intercept(m, b), 6) AS intercept FROM b WHERE b BETWEEN 1 AND 10"""
)
def speed_freq_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Mean signal by speed bin and the line through the inner bins."""
    b = F.least(F.greatest(F.floor((F.col("speed") - 5) / 400) + 1, F.lit(0)), F.lit(11))
    means = _kin(spark, sf).join(A.events(spark, sf).select("i", "v"), "i").groupBy(b.alias("b")).agg(F.avg("v").alias("m")).where("b between 1 and 10")
    line = means.agg(F.count("*").alias("n"), F.regr_slope("m", "b").alias("slope"), F.regr_intercept("m", "b").alias("intercept"))
    return line.select("n", *r6("slope", "intercept"))


@query(
    """, a AS (SELECT i, cell, t_s, last_value(CASE WHEN tet = 'purchase' THEN t_s END IGNORE NULLS) OVER (PARTITION BY cell ORDER BY i) AS p,
       first_value(CASE WHEN tet = 'purchase' THEN t_s END IGNORE NULLS) OVER (PARTITION BY cell ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM ev)
SELECT i, cell, round(CASE WHEN q IS NULL OR t_s - p <= q - t_s THEN t_s - p ELSE t_s - q END, 6) AS since FROM a WHERE p IS NOT NULL OR q IS NOT NULL"""
)
def nearest_fixed_trial(spark: SparkSession, sf: str) -> DataFrame:
    """Time since, or if negative until, the nearest event of one type of the same cell; ties to the earlier."""
    mark = F.when(F.col("tet") == "purchase", F.col("t_s"))
    e = S.last_known(A.events(spark, sf), mark, "p", keys=("cell",))
    e = S.last_known(e, mark, "q", keys=("cell",), ahead=True).where("p is not null or q is not null")
    before, after = F.col("t_s") - F.col("p"), F.col("q") - F.col("t_s")
    return e.withColumn("since", F.when(F.col("q").isNull() | (before <= after), before).otherwise(-after)).select("i", "cell", *r6("since"))


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("tet"), F.col("user_id").alias("cell"), F.col("value").alias("v"))


@query(" SELECT tet, (floor(t_s / 600) * 600)::BIGINT AS start_s, count(*) AS n, round(avg(v), 6) AS mean_v FROM ev GROUP BY 1, 2")
def windowed_activity(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming operator's batch form."""
    w = streams.windowed_counts(_timed(spark, sf))
    start = (F.unix_timestamp("start") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))).alias("start_s")
    return w.select("tet", start, "n", *r6("mean_v"))


@query(
    """, g AS (SELECT cell, i, t_s, coalesce(t_s - lag(t_s) OVER (PARTITION BY cell ORDER BY i) >= 7200, true) AS st FROM ev
), s AS (SELECT *, sum(st::INT) OVER (PARTITION BY cell ORDER BY i) AS k FROM g)
SELECT cell, round(min(t_s) * 1000000)::BIGINT AS start_us, count(*) AS n FROM s GROUP BY cell, k"""
)
def cell_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming operator's batch form."""
    s = streams.sessions(_timed(spark, sf), "2 hours")
    return s.select("cell", (F.unix_micros("start") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))).alias("start_us"), "n")


# -- tracked lights, resampling ----------------------------------------------


def _track(spark: SparkSession, sf: str) -> DataFrame:
    """One track of all samples, masked where the signal is low."""
    return A.positions(spark, sf, masked=True).withColumn("trial", F.lit(1))


@query(" SELECT round(quantile_cont(x, 0.005), 6) AS x1, round(quantile_cont(x, 0.995), 6) AS x2, round(quantile_cont(y, 0.005), 6) AS y1, round(quantile_cont(y, 0.995), 6) AS y2 FROM mpos")
def track_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    return tracking.fit_rectangle(_track(spark, sf), ("trial",)).select(*r6("x1", "x2", "y1", "y2"))


@query(
    """, e AS (SELECT i, x, min_by(x, i) OVER () AS f, max_by(x, i) OVER () AS l, max(i) OVER () AS m FROM pos)
SELECT i, round((sum(x) OVER (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) + greatest(10 - i, 0) * f + greatest(i + 9 - m, 0) * l) / 20, 6) AS x FROM e"""
)
def track_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    at = A.positions(spark, sf).withColumn("trial", F.lit(1))
    return S.boxcar(at, "x", 20, "x", ("trial",)).select("i", *r6("x"))


_LIGHTS = """, a AS (SELECT i, x AS ax, y AS ay, k::DOUBLE AS an, y AS bx, x AS by_, v AS bn FROM mpos JOIN ev USING (i)
), n AS (SELECT *, lead(ax) OVER w AS cx, lead(ay) OVER w AS cy, lead(bx) OVER w AS dx, lead(by_) OVER w AS dy, avg(an) OVER () AS ma, stddev_pop(an) OVER () AS sa,
        avg(bn) OVER () AS mb, stddev_pop(bn) OVER () AS sb FROM a WINDOW w AS (ORDER BY i)
), s AS (SELECT *, coalesce((sqrt(power(cx - ax, 2) + power(cy - ay, 2)) - sqrt(power(cx - bx, 2) + power(cy - by_, 2)) > 5
        OR sqrt(power(dx - bx, 2) + power(dy - by_, 2)) - sqrt(power(dx - ax, 2) + power(dy - ay, 2)) > 5) AND (ma - an) / sa > (an - mb) / sb, false) AS sw FROM n)
SELECT i, 0 AS led, round(CASE WHEN sw THEN bx ELSE ax END, 6) AS px, round(CASE WHEN sw THEN by_ ELSE ay END, 6) AS py FROM s
UNION ALL SELECT i, 1, round(CASE WHEN sw THEN ax ELSE bx END, 6), round(CASE WHEN sw THEN ay ELSE by_ END, 6) FROM s"""


@query(_LIGHTS)
def track_swapped_lights(spark: SparkSession, sf: str) -> DataFrame:
    at = _track(spark, sf).join(A.events(spark, sf).select("i", "k", "v"), "i")
    light = lambda n, x, y, size: F.struct(F.lit(n).alias("led"), F.col(x).alias("px"), F.col(y).alias("py"), F.col(size).cast("double").alias("npix"))
    leds = at.select("trial", "i", F.inline(F.array(light(0, "x", "y", "k"), light(1, "y", "x", "v"))))
    return tracking.swap_lights(leds, ("trial",)).select("i", "led", *r6("px", "py"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return A.positions(spark, sf)


_DRAW = "('0x' || substr(md5('0:' || rep || ':' || i), 1, 15))::BIGINT"


@query(
    f""", k AS (SELECT unnest(range(1, 101)) AS rep), h AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY {_DRAW}) - 1 AS i FROM pos, k
), r AS (SELECT rep, corr(pos.x, h.y) AS r FROM h JOIN pos USING (i) GROUP BY rep)
SELECT round((SELECT corr(x, y) FROM pos), 6) AS r, avg((abs(r) > abs((SELECT corr(x, y) FROM pos)))::INT) AS p FROM r"""
)
def pearson_permutations(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.permutation_test(_pairs(spark, sf)).select(*r6("r"), "p")


@query(
    f""", k AS (SELECT unnest(range(1, 1001)) AS rep), d AS (SELECT rep, {_DRAW} % (SELECT count(*) FROM pos) AS i FROM pos, k
), r AS (SELECT rep, sign(count(*) * sum(x * y) - sum(x) * sum(y)) AS s FROM d JOIN pos USING (i) GROUP BY rep)
SELECT round((SELECT corr(x, y) FROM pos), 6) AS r, avg((s <> (SELECT sign(corr(x, y)) FROM pos))::INT) AS p FROM r"""
)
def pearson_sign_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.sign_bootstrap(_pairs(spark, sf)).select(*r6("r"), "p")


# -- replay --------------------------------------------------------------------

_STATES = (
    _EVENTS
    + f""", b AS (SELECT (r)::INT AS gx, 5 + 10 * r AS c FROM range(10) t(r)), q AS (SELECT i, tet, round(x / 0.1) * 0.1 AS x FROM pos JOIN ev USING (i)
), dw AS (SELECT gx, sum(exp(-0.5 * power((x - c) / 3, 2))) AS w FROM q, b GROUP BY 1), ds AS (SELECT tet, gx, sum(exp(-0.5 * power((x - c) / 3, 2))) AS n FROM q, b GROUP BY 1, 2
), fi AS (SELECT tet, gx, greatest(n / w, 1e-15::DOUBLE) AS rate FROM ds JOIN dw USING (gx)
), tp AS (SELECT event FROM es GROUP BY event ORDER BY count(*) DESC, event LIMIT 1
), tb AS (SELECT unnest(range(0, floor(round(tb - ta, 6) / 60)::BIGINT + 1)) AS t FROM span JOIN tp USING (event)
), ct AS (SELECT floor(round(t_s - ta, 6) / 60)::BIGINT AS t, tet, count(*) AS n FROM es JOIN span USING (event) JOIN tp USING (event) GROUP BY 1, 2
), si AS (SELECT gx, -sum(rate) AS s FROM fi GROUP BY 1), fd AS (SELECT t, gx, sum(n * ln(rate)) AS f FROM ct JOIN fi USING (tet) GROUP BY 1, 2
), ll AS (SELECT t, gx, coalesce(f, 0) + s AS ll FROM tb CROSS JOIN si LEFT JOIN fd USING (t, gx)
), mv AS (SELECT {D.event_states(10, 10.0, 100.0)}::DOUBLE[][] AS m
), lo AS (SELECT t, list(exp(ll - mx) ORDER BY gx) AS l FROM (SELECT *, max(ll) OVER (PARTITION BY t) AS mx FROM ll) GROUP BY t
), lt AS (SELECT t, list_concat(list_concat(l, l), l) AS l FROM lo
), cf AS (SELECT t, list_transform(l, lambda x: x / list_sum(l)) AS p FROM lt WHERE t = 0
    UNION ALL SELECT t, list_transform(q, lambda x: x / list_sum(q)) FROM (
        SELECT lt.t, list_transform(range(1, 31), lambda b: l[b] * list_sum(list_transform(range(1, 31), lambda a: p[a] * m[a][b]))) AS q FROM cf JOIN lt ON lt.t = cf.t + 1, mv)
), sm AS (SELECT t, p FROM cf WHERE t = (SELECT max(t) FROM cf)
    UNION ALL SELECT t, list_transform(q, lambda x: x / list_sum(q)) FROM (
        SELECT cf.t, list_transform(range(1, 31), lambda a: cf.p[a] * list_sum(list_transform(range(1, 31), lambda b: m[a][b] * sm.p[b]
            / list_sum(list_transform(range(1, 31), lambda c: cf.p[c] * m[c][b]))))) AS q FROM sm JOIN cf ON cf.t = sm.t - 1, mv)
)"""
)


@query(
    _STATES
    + """ SELECT event, t, ['continuous', 'fragmented', 'stationary'][k + 1] AS state, round(list_sum(p[10 * k + 1:10 * k + 10]), 6) AS p FROM sm, tp, range(3) r(k)""",
    recursive=True,
)
def event_classification(spark: SparkSession, sf: str) -> DataFrame:
    """The busiest event, a minute of it a time bin: is what its spikes stand for moving on, jumping or staying?"""
    spikes = materialize(_event_spikes(spark, sf).select("event", "tet", "t_s", "ta", "tb"), "event-spikes")
    top = spikes.groupBy("event", "ta", "tb").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event").limit(1)
    spans = top.select("event", (F.floor(F.round(F.col("tb") - F.col("ta"), 6) / 60) + 1).alias("n_t"))
    inside = spikes.join(F.broadcast(spans), "event")  # one event
    counts = inside.groupBy("event", F.floor(F.round(F.col("t_s") - F.col("ta"), 6) / 60).alias("t"), F.col("tet").alias("cell")).agg(F.count("*").alias("n"))
    spk = _spike_pos(spark, sf, None).select(F.col("tet").alias("cell"), "x")
    bins = D.place_bins(spark, 0.0, 100.0, 100.0)
    fields = D.kernel_fields(spk, A.positions(spark, sf), bins, FS)
    return D.classify(counts, spans, fields, 1 / FS, 10, 10.0, 100.0, "event").select("event", "t", "state", *r6("p"))


# -- fields and grids ----------------------------------------------------------


def _shifted_maps(spark: SparkSession, sf: str, shifts: list[int]) -> DataFrame:
    """Rate maps of one cell's spikes moved around the recording."""
    pos, spk = A.positions(spark, sf), A.spikes(spark, sf).where(F.col("tet") == CELL)
    bins = [B.xy_bin(F.col(c), SIZE).alias("g" + c) for c in "yx"]
    dwell = pos.groupBy(*bins).agg(F.count("*").alias("dwell"))
    moved = fields.circular_shifts(spk, pos.count(), shifts)
    hits = joins.gather(moved, pos).groupBy("shift", *bins).agg(F.count("*").alias("n"))
    every = dwell.select("*", F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift"))
    return every.join(hits, ["shift", "gy", "gx"], "left").select("shift", "gy", "gx", (F.coalesce("n", F.lit(0)) * FS / F.col("dwell")).alias("rate"))


@query(
    """, sh AS (SELECT unnest([0, 100, 200]) AS shift), dw AS (SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) AS dwell FROM pos GROUP BY 1, 2
), mv AS (SELECT shift, (i + shift) % (SELECT count(*) FROM pos) AS i FROM ev, sh WHERE tet = 'click'
), hit AS (SELECT shift, floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) AS n FROM mv JOIN pos USING (i) GROUP BY 1, 2, 3)
SELECT shift, gy, gx, round(coalesce(n, 0) * 50.0::DOUBLE / dwell, 6) AS rate FROM dw CROSS JOIN sh LEFT JOIN hit USING (shift, gy, gx)"""
)
def shifted_ratemaps(spark: SparkSession, sf: str) -> DataFrame:
    return _shifted_maps(spark, sf, [0, 100, 200]).select("shift", "gy", "gx", *r6("rate"))


@query(
    """, m AS (SELECT floor(y / 10)::INT AS gy, floor(x / 10)::INT AS gx, count(*) FILTER (WHERE tet = 'click') * 50.0::DOUBLE / count(*) AS rate FROM pos JOIN ev USING (i) GROUP BY 1, 2
), bb AS (SELECT min(gy) AS a, max(gy) AS b, min(gx) AS c, max(gx) AS d FROM m), gr AS (SELECT unnest(range(a, b + 1)) AS gy, c, d FROM bb), gg AS (SELECT gy, unnest(range(c, d + 1)) AS gx FROM gr
), v AS (SELECT gy, gx, coalesce(rate, 0) AS v FROM gg LEFT JOIN m USING (gy, gx)
), tp AS (SELECT p.gy, p.gx FROM v p JOIN v q ON abs(p.gy - q.gy) <= 1 AND abs(p.gx - q.gx) <= 1
          GROUP BY p.gy, p.gx HAVING trunc(any_value(p.v) * 255.0 / (SELECT max(v) FROM v)) > 10 AND max(trunc(q.v * 255.0 / (SELECT max(v) FROM v))) = trunc(any_value(p.v) * 255.0 / (SELECT max(v) FROM v))
), co AS (SELECT gy, gx, gy AS oy, gx AS ox FROM tp
    UNION SELECT co.gy, co.gx, tp.gy, tp.gx FROM co JOIN tp ON abs(tp.gy - co.oy) <= 1 AND abs(tp.gx - co.ox) <= 1
), dm AS (SELECT a, c, b - a + 1 AS ht, d - c + 1 AS w FROM bb
), mk AS (SELECT list(k ORDER BY k) AS ms FROM (SELECT DISTINCT max((oy - a) * w + ox - c) AS k FROM co, dm GROUP BY gy, gx)
), hl AS (SELECT list(255 - trunc((v - lo) * (255.0::DOUBLE / (hi - lo)))::BIGINT ORDER BY gy, gx) AS h FROM v, (SELECT min(v) AS lo, max(v) AS hi FROM v)
), fd AS (SELECT list_transform(range(w * ht), lambda k: CASE WHEN list_contains(ms, k) THEN k ELSE -1 END) AS lab,
          list_transform(ms, lambda k, j: h[k + 1] * 1000000000 + j * 10000 + k) AS q, len(ms)::BIGINT AS age FROM dm, mk, hl
    UNION ALL SELECT list_transform(lab, lambda l, j: CASE WHEN list_contains(nb, j - 1) THEN lab[e % 10000 + 1] ELSE l END),
          list_concat(list_filter(q, lambda x: x <> e), list_transform(nb, lambda k, j: h[k + 1] * 1000000000 + (age + j) * 10000 + k)), age + len(nb)
    FROM (SELECT lab, q, age, e, h, list_filter([CASE WHEN e % 10000 >= w THEN e % 10000 - w END, CASE WHEN e % 10000 % w > 0 THEN e % 10000 - 1 END,
              CASE WHEN e % 10000 % w < w - 1 THEN e % 10000 + 1 END, CASE WHEN e % 10000 < w * (ht - 1) THEN e % 10000 + w END], lambda k: k IS NOT NULL AND lab[k + 1] < 0) AS nb
          FROM (SELECT *, list_min(q) AS e FROM fd WHERE len(q) > 0), hl, dm)
), en AS (SELECT u.k // w + a AS gy, u.k % w + c AS gx, lab[u.k + 1] AS m FROM fd, dm, unnest(range(w * ht)) AS u(k) WHERE len(q) = 0
), fl AS (SELECT en.gy, en.gx, m, v.v, top.v AS peak FROM en, dm JOIN v ON v.gy = en.gy AND v.gx = en.gx JOIN v top ON top.gy = m // w + a AND top.gx = m % w + c WHERE v.v >= 0.5 * top.v
), nm AS (SELECT m, row_number() OVER (ORDER BY any_value(peak) DESC, m DESC) AS label FROM fl GROUP BY m)
SELECT 0 AS shift, gy::INT AS gy, gx::INT AS gx, round(v, 6) AS rate, label::INT AS label FROM fl JOIN nm USING (m)""",
    recursive=True,
)
def map_fields(spark: SparkSession, sf: str) -> DataFrame:
    found = fields.find_fields(_shifted_maps(spark, sf, [0]), ("shift",), SIZE, least_cm2=100.0)
    return found.select("shift", "gy", "gx", *r6("rate"), "label")


@query()
def gridness_ellipse(spark: SparkSession, sf: str) -> DataFrame:
    """Grid measures of each kind of event, the ring of peaks made round before."""
    pos = A.positions(spark, sf)
    m = B.rate_map(pos, joins.gather(A.spikes(spark, sf), pos), 5.0, (21, 21), FS, B.gaussian(1.5), keys=("tet",)).where("rate is not null")
    return fields.grid_measures(maps.autocorrelation(m, ("tet",)), ("tet",), 5.0, ellipse=True)


@query()
def gridness_shuffles(spark: SparkSession, sf: str) -> DataFrame:
    """Grid measures of a cell and of its spikes moved around the recording (shift 0 is the cell itself)."""
    n = A.positions(spark, sf).count()
    maps_ = _shifted_maps(spark, sf, [0, *fields.random_shifts(n, 100, int(20 * FS))])
    return fields.grid_measures(maps.autocorrelation(maps_, ("shift",)), ("shift",), SIZE)
