"""Registered queries on the test tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import pairs
from ..operators import relational as R
from ..params import Association, Grid, Neural, Pairing
from . import adapters as A

ASSOC, PAIR, NEURAL = Association(), Pairing(), Neural()
#: On the test tables spacing is wide: values that give every operator work to do.
OT_DEV = 2_000_000
PAIR_T = Pairing(loc_dev=(3.0, 3.0, 1.5), num_sta=2, max_nbr=5, cc_thres=0.3, dt_thres=(0.5, 0.8), dep_dev=5.0, epi_max=120.0, pair_max=40.0)
GRID = Grid(lat=(35.0, 37.0), lon=(-118.0, -116.0), num=(4, 3), pad=(0.05, 0.04))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, tables: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = A.with_tables(tables, sql) if tables else sql
        return f

    return add


def _timed(s, d):
    return R.with_day(R.with_origin_time(A.picks(s, d), ASSOC.vp, ASSOC.vs), "sta_ot_us")


@query("SELECT event_id, net_sta, tp_us, ts_us, sta_ot_us FROM timed", "pick")
def origin_time(s, d):
    return R.with_origin_time(A.picks(s, d), ASSOC.vp, ASSOC.vs).select("event_id", "net_sta", "tp_us", "ts_us", "sta_ot_us")


@query("SELECT event_id, net_sta FROM pick WHERE net_sta IN (SELECT net_sta FROM station)", "pick")
def known_station_semi(s, d):
    return R.known_stations(A.picks(s, d), A.stations(s, d)).select("event_id", "net_sta")


@query("SELECT event_id, tp_us, ts_us FROM pick WHERE tp_us <= ts_us", "pick")
def tp_after_ts_filter(s, d):
    return R.ordered_phases(A.picks(s, d)).select("event_id", "tp_us", "ts_us")


COUNTED = f""", counted AS (SELECT *, sta_ot_us // {R.DAY_US} AS day, count(*) OVER (PARTITION BY sta_ot_us // {R.DAY_US} ORDER BY sta_ot_us RANGE BETWEEN {OT_DEV - 1} PRECEDING AND {OT_DEV - 1} FOLLOWING) AS n_nbr FROM timed)"""


@query(COUNTED + " SELECT event_id, sta_ot_us, day, n_nbr FROM counted", "pick")
def ot_neighbour_count(s, d):
    return R.neighbour_counts(_timed(s, d), OT_DEV).select("event_id", "sta_ot_us", "day", "n_nbr")


DENSE = ", dense AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY day ORDER BY n_nbr DESC, sta_ot_us, net_sta, tp_us, ts_us, s_amp) = 1)"


@query(COUNTED + DENSE + " SELECT day, sta_ot_us, net_sta, tp_us, n_nbr FROM dense", "pick")
def dense_ot_argmax(s, d):
    return R.densest(R.neighbour_counts(_timed(s, d), OT_DEV))


@query(COUNTED + DENSE + f", near AS (SELECT c.day, c.sta_ot_us FROM counted c JOIN dense x ON c.day = x.day AND abs(c.sta_ot_us - x.sta_ot_us) < {OT_DEV}) SELECT day, count(*) AS n, list_sort(list(sta_ot_us))[len(list(sta_ot_us)) // 2 + 1] AS ot_us FROM near GROUP BY day", "pick")
def cluster_origin_time(s, d):
    t = _timed(s, d)
    return R.cluster_origin(t, R.densest(R.neighbour_counts(t, OT_DEV)), OT_DEV)


NS, NL = 8, 60
CF = f""", m AS (SELECT chn, idx, v, count(*) OVER (PARTITION BY chn) AS size,
 sum(v) OVER (PARTITION BY chn ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {NS} FOLLOWING) / {NS} AS sta, sum(v) OVER (PARTITION BY chn ORDER BY idx ROWS BETWEEN {NL - 1} PRECEDING AND CURRENT ROW) / {NL} AS lta FROM sample),
 c AS (SELECT chn, idx, CASE WHEN idx < {NL} OR size < {NL + NS} OR lta = 0 THEN 0.0 WHEN idx < size - {NS} THEN sta / lta ELSE 0.0 END AS cf FROM m)"""


@query(CF + " SELECT chn, idx, round(cf, 6) AS cf FROM c", "sample")
def stalta(s, d):
    return R.sta_lta(A.samples(s, d), NS, NL).select("chn", "idx", F.round("cf", 6).alias("cf"))


@query(CF + " SELECT chn, idx FROM c WHERE cf > 1.500001", "sample")
def stalta_trigger(s, d):
    return R.sta_lta(A.samples(s, d), NS, NL).where("cf > 1.500001").select("chn", "idx")


@query("SELECT chn, idx, round(v - lag(v) OVER (PARTITION BY chn ORDER BY idx), 6) AS diff FROM sample", "sample")
def first_diff(s, d):
    return R.first_difference(A.samples(s, d)).select("chn", "idx", F.round("diff", 6).alias("diff"))


@query("SELECT chn, idx, round(sqrt(e), 6) AS norm FROM (SELECT chn, idx, sum(v * v) OVER w AS e, count(*) OVER w AS m FROM sample WINDOW w AS (PARTITION BY chn ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)) WHERE m = 20", "sample")
def energy_norm(s, d):
    return R.energy_norm(A.samples(s, d), 20).select("chn", "idx", F.round("norm", 6).alias("norm"))


@query("SELECT chn, idx, round(k, 5) AS kurt FROM (SELECT chn, idx, kurtosis_pop(v) OVER w AS k, count(*) OVER w AS m FROM sample WINDOW w AS (PARTITION BY chn ORDER BY idx ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) WHERE m = 50", "sample")
def rolling_kurtosis(s, d):
    return R.rolling_kurtosis(A.samples(s, d), 50).select("chn", "idx", F.round("kurt", 5).alias("kurt"))


RUNS = ", hit AS (SELECT chn, idx, idx - row_number() OVER (PARTITION BY chn ORDER BY idx) AS run FROM sample WHERE v > 40) SELECT chn, min(idx) AS first, max(idx) AS last, count(*) AS n, median(idx) AS middle FROM hit GROUP BY chn, run"


@query(RUNS, "sample")
def gap_islands(s, d):
    return R.gaps_and_islands(A.samples(s, d).where("v > 40").select("chn", "idx"))


@query("SELECT event_type, w AS win_us, count(*) AS n FROM (SELECT event_type, unnest([tp_us // 10000000 * 10000000 - 10000000, tp_us // 10000000 * 10000000]) AS w FROM pick) GROUP BY ALL", "pick")
def sliding_window_counts(s, d):
    """20 s windows every 10 s."""
    p = A.picks(s, d).select("event_type", F.timestamp_micros("tp_us").alias("t"))
    return p.groupBy("event_type", F.window("t", "20 seconds", "10 seconds")).agg(F.count("*").alias("n")).select("event_type", F.unix_micros("window.start").alias("win_us"), "n")


@query("SELECT event_type, min(tp_us) AS start_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY tp_us, event_id) AS g FROM (SELECT *, CASE WHEN tp_us - lag(tp_us) OVER (PARTITION BY event_type ORDER BY tp_us, event_id) < 5000000 THEN 0 ELSE 1 END AS new FROM pick)) GROUP BY event_type, g", "pick")
def session_gap(s, d):
    """Sessions of picks less than 5 s apart (exclusive, as in the streaming twin)."""
    p = A.picks(s, d).select("event_type", F.timestamp_micros("tp_us").alias("t"))
    return p.groupBy("event_type", F.session_window("t", "5 seconds")).agg(F.count("*").alias("n")).select("event_type", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("""WITH RECURSIVE t AS (SELECT event_type AS chn, epoch_us(ts) // 100 AS t_us FROM events), taken AS (SELECT chn, min(t_us) AS t_us FROM t GROUP BY chn UNION ALL
 SELECT x.chn, (SELECT min(t.t_us) FROM t WHERE t.chn = x.chn AND t.t_us > x.t_us + 300000000) FROM taken x WHERE x.t_us IS NOT NULL) SELECT chn, t_us FROM taken WHERE t_us IS NOT NULL""")
def deadtime_chain(s, d):
    return R.dead_time(A.read(s, d, "events").select(F.col("event_type").alias("chn"), F.floor(X.micros(F.col("ts")) / 100).cast("long").alias("t_us")), 300_000_000)


GAINS = ", gain AS (SELECT net_sta, ord, CASE ord WHEN 1 THEN NULL ELSE (SELECT min(tp_us) FROM pick) + CAST(ord - 2 AS BIGINT) * 2000000000 END AS t0, CASE ord WHEN 1 THEN NULL ELSE (SELECT min(tp_us) FROM pick) + CAST(ord - 1 AS BIGINT) * 2000000000 END AS t1, ord * 100.0 + sta_id AS gain, sta_id FROM station, (SELECT unnest([1, 2, 3, 4]) AS ord) WHERE CASE WHEN sta_id % 3 = 0 THEN ord = 1 ELSE ord > 1 END)"


@query(GAINS + ", j AS (SELECT p.event_id AS trace_id, p.net_sta, g.ord, g.gain, g.t0 IS NULL OR (g.t0 < p.tp_us AND p.tp_us < g.t1) AS ins FROM pick p JOIN gain g USING (net_sta)) SELECT trace_id, net_sta, ord, gain FROM j QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY CASE WHEN ins THEN 0 ELSE 1 END, CASE WHEN ins THEN ord ELSE -ord END) = 1", "pick")
def gain_interval_join(s, d):
    p = A.picks(s, d)
    t0 = p.agg(F.min("tp_us").alias("t0"))
    g = A.stations(s, d).select("net_sta", "sta_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("ord")).where("(sta_id % 3 = 0 and ord = 1) or (sta_id % 3 <> 0 and ord > 1)")
    g = g.join(F.broadcast(t0)).select("net_sta", "ord", F.when(F.col("ord") > 1, F.col("t0") + (F.col("ord") - 2).cast("long") * 2_000_000_000).alias("t0_us"), F.when(F.col("ord") > 1, F.col("t0") + (F.col("ord") - 1).cast("long") * 2_000_000_000).alias("t1_us"), (F.col("ord") * F.lit(100.0) + F.col("sta_id")).alias("gain"))
    return R.gain_at(p.select(F.col("event_id").alias("trace_id"), "net_sta", F.col("tp_us").alias("mid_us")), g)


FLAGS = f""", day AS (SELECT *, tp_us // {R.DAY_US} AS day FROM pick), mark AS (SELECT DISTINCT day, tp_us FROM day WHERE event_id % 3 = 0), flag AS (SELECT d.event_id, d.net_sta, d.day, m.tp_us IS NOT NULL AS is_assoc FROM day d LEFT JOIN mark m ON m.day = d.day AND m.tp_us = d.tp_us)"""


def _flags(s, d):
    p = R.with_day(A.picks(s, d), "tp_us")
    return R.association_flags(p, p.where("event_id % 3 = 0"))


@query(FLAGS + " SELECT event_id, net_sta, day, is_assoc FROM flag", "pick")
def assoc_flags(s, d):
    return _flags(s, d).select("event_id", "net_sta", "day", "is_assoc")


COUNTS = FLAGS + ", cnt AS (SELECT net_sta, day, count(*) FILTER (NOT is_assoc) AS n_un, count(*) FILTER (is_assoc) AS n_as FROM flag GROUP BY net_sta, day)"


@query(COUNTS + " SELECT * FROM cnt", "pick")
def station_date_counts(s, d):
    return R.station_day_counts(_flags(s, d))


@query(COUNTS + " SELECT net_sta, day, n_un, n_as, CASE WHEN n_as / (n_un + n_as) >= 0.9 THEN 0 ELSE CAST(floor(n_un * (SELECT 2.0 * sum(n_as) / sum(n_un) FROM cnt) * (0.9 - n_as / (n_un + n_as)) / 0.9 + 1e-9) AS BIGINT) END AS quota FROM cnt", "pick")
def negative_quota(s, d):
    return R.negative_quota(R.station_day_counts(_flags(s, d)), 2.0, 0.9)


@query("SELECT q.event_id, q.net_sta FROM (SELECT event_id, net_sta, tp_us + event_id % 5 * 700000 - 1000000 AS t0_us, tp_us + event_id % 5 * 700000 + 3000000 AS t1_us FROM pick) q WHERE NOT EXISTS (SELECT 1 FROM pick p WHERE p.net_sta = q.net_sta AND p.tp_us > q.t0_us AND p.tp_us < q.t1_us AND p.ts_us > q.t0_us AND p.ts_us < q.t1_us)", "pick")
def noise_window_anti(s, d):
    p = A.picks(s, d)
    t = F.col("tp_us") + F.col("event_id") % 5 * 700_000
    return R.noise_windows(p.select("event_id", "net_sta", (t - 1_000_000).alias("t0_us"), (t + 3_000_000).alias("t1_us")), p.select("net_sta", "tp_us", "ts_us")).select("event_id", "net_sta")


RAD = 3.141592653589793 / 180
MAGS = f", sm AS (SELECT p.event_id, p.net_sta, p.seq, log10(p.s_amp * 1e6) + log10(sqrt(pow(111.0 * (s.lon - e.lon) * cos(s.lat * {RAD!r}), 2) + pow(111.0 * (s.lat - e.lat), 2) + pow(e.dep + s.ele / 1000, 2))) + 1 AS mag FROM phase p JOIN event e USING (event_id) JOIN station s USING (net_sta))"


def _mags(s, d):
    return R.station_magnitudes(A.phases(s, d), A.catalog(s, d), A.stations(s, d))


@query(MAGS + " SELECT event_id, net_sta, seq, round(mag, 6) AS mag FROM sm", "phase")
def station_magnitude(s, d):
    return _mags(s, d).select("event_id", "net_sta", "seq", F.round("mag", 6).alias("mag"))


@query(MAGS + ", dev AS (SELECT *, round(abs(mag - median(mag) OVER (PARTITION BY event_id)), 9) AS dev FROM sm), rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dev DESC, seq, net_sta, mag) AS rk FROM dev) SELECT event_id, round(median(mag), 6) AS mag, count(*) AS n_used FROM rk WHERE rk > 1 GROUP BY event_id", "phase")
def event_magnitude_trimmed(s, d):
    return R.event_magnitudes(_mags(s, d)).select("event_id", F.round("mag", 6).alias("mag"), "n_used")


TT = f""", box AS (SELECT min(lon) - {ASSOC.xy_margin} * (max(lon) - min(lon)) AS lon0, max(lon) + {ASSOC.xy_margin} * (max(lon) - min(lon)) AS lon1, min(lat) - {ASSOC.xy_margin} * (max(lat) - min(lat)) AS lat0, max(lat) + {ASSOC.xy_margin} * (max(lat) - min(lat)) AS lat1 FROM station),
 tt AS MATERIALIZED (SELECT net_sta, zi, xi, yi, sqrt(pow(111.0 * (lon0 + xi * {ASSOC.xy_grid} - lon) * cos(lat * {RAD!r}), 2) + pow(111.0 * (lat0 + yi * {ASSOC.xy_grid} - lat), 2) + pow(z + ele / 1000, 2)) / {ASSOC.vp} AS ttp
 FROM station, box, (SELECT unnest(range(0, 100)) AS xi), (SELECT unnest(range(0, 100)) AS yi), (VALUES {", ".join(f"({i}, {z!r})" for i, z in enumerate(ASSOC.z_grids))}) g(zi, z) WHERE xi < floor((lon1 - lon0) / {ASSOC.xy_grid}) AND yi < floor((lat1 - lat0) / {ASSOC.xy_grid}))"""


@query(TT + " SELECT net_sta, CAST(zi AS INT) AS zi, CAST(xi AS INT) AS xi, CAST(yi AS INT) AS yi, round(ttp, 6) AS ttp FROM tt", "station")
def traveltime_grid(s, d):
    return R.travel_times(A.stations(s, d), ASSOC).select("net_sta", "zi", "xi", "yi", (F.rint(F.col("ttp") * 1e6) / 1e6).alias("ttp"))


def _clusters(s, d):
    t = _timed(s, d)
    centre = R.densest(R.neighbour_counts(t, OT_DEV)).select("day", F.col("sta_ot_us").alias("centre"))
    near = t.join(centre, "day").where(F.abs(F.col("sta_ot_us") - F.col("centre")) < OT_DEV)
    return near.select(F.col("day").alias("cluster_id"), F.col("centre").alias("ot_us"), "net_sta", "tp_us")


@query(COUNTED + DENSE + f", near AS MATERIALIZED (SELECT c.day, x.sta_ot_us AS ot_us, c.net_sta, c.tp_us FROM counted c JOIN dense x ON c.day = x.day AND abs(c.sta_ot_us - x.sta_ot_us) < {OT_DEV})" + TT + ", hit AS (SELECT day, zi, xi, yi, abs(ttp - (tp_us - ot_us) / 1e6) AS res FROM near JOIN tt USING (net_sta) WHERE abs(ttp - (tp_us - ot_us) / 1e6) < 1.5), cell AS (SELECT day, zi, xi, yi, count(*) AS num_sta, round(sum(res), 9) AS res FROM hit GROUP BY ALL) SELECT day AS cluster_id, num_sta, round(res / num_sta, 6) AS res, CAST(zi AS INT) AS zi, CAST(xi AS INT) AS xi, CAST(yi AS INT) AS yi FROM cell QUALIFY row_number() OVER (PARTITION BY day ORDER BY num_sta DESC, res, zi, xi, yi) = 1", "pick")
def cell_scan_best(s, d):
    return R.cell_scan(_clusters(s, d), A.stations(s, d), ASSOC, 1.5)


CAND = ", cand AS (SELECT event_id AS evid, seq AS cand, substr('ABCD', CAST(event_id * seq % 4 + 1 AS INT), 1) AS qua, (event_id * 7 + seq * 31) % 360 AS azm, (event_id + seq * 3) % 12 + 4 AS npha, (seq * 13 % 50) / 100.0 AS rms, (event_id + seq) % 5 <> 0 AS is_loc FROM phase)"


def _cands(s, d):
    e, q = F.col("event_id"), F.col("seq")
    return A.phases(s, d).select(e.alias("evid"), q.alias("cand"), F.substr(F.lit("ABCD"), (e * q % 4 + 1).cast("int"), F.lit(1)).alias("qua"), ((e * 7 + q * 31) % 360).alias("azm"), ((e + q * 3) % 12 + 4).alias("npha"), ((q * 13 % 50).cast("double") / 100).alias("rms"), ((e + q) % 5 != 0).alias("is_loc"))


BEST = CAND + ", best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY evid ORDER BY is_loc DESC, qua, azm, npha DESC, rms, cand) = 1)"


@query(BEST + " SELECT evid, cand, qua, azm, npha, is_loc FROM best", "phase")
def location_best_candidate(s, d):
    return R.best_location(_cands(s, d)).select("evid", "cand", "qua", "azm", "npha", "is_loc")


@query(BEST + " SELECT CASE WHEN is_loc THEN 'good' ELSE 'bad' END AS kind, qua, count(*) AS n FROM best GROUP BY ALL", "phase")
def reliable_split(s, d):
    """K14, F19."""
    return R.best_location(_cands(s, d)).groupBy(F.when(F.col("is_loc"), "good").otherwise("bad").alias("kind"), "qua").agg(F.count("*").alias("n"))


def _cells_sql(pad: bool) -> str:
    rows = ", ".join(f"({i}, {j}, {a!r}, {b!r}, {c!r}, {e!r})" for i, j, a, b, c, e in R.grid_cells(GRID, pad))
    return f"SELECT event_id, i, j FROM event JOIN (VALUES {rows}) t(i, j, a, b, c, e) ON lat > a AND lat <= b AND lon > c AND lon <= e"


@query(_cells_sql(True), "event")
def grid_cell_assign(s, d):
    return R.assign_cells(A.catalog(s, d), GRID, True)


@query(_cells_sql(False), "event")
def grid_owner(s, d):
    return R.assign_cells(A.catalog(s, d), GRID, False)


@query(f"SELECT event_id, i, j FROM ({_cells_sql(True)}) SEMI JOIN ({_cells_sql(False)}) USING (event_id, i, j)", "event")
def owner_dedupe(s, d):
    return R.owned(R.assign_cells(A.catalog(s, d), GRID, True), R.assign_cells(A.catalog(s, d), GRID, False))


NEAR = f""", pair AS (SELECT a.event_id AS evid1, b.event_id AS evid2 FROM event a JOIN event b ON a.event_id < b.event_id AND b.dep < a.dep + 1.5 AND b.dep > a.dep - 1.5 WHERE 111.0 * abs(a.lat - b.lat) < 3.0 AND 111.0 * abs(a.lon - b.lon) * least(cos(a.lat * {RAD!r}), cos(b.lat * {RAD!r})) < 3.0 AND abs(a.dep - b.dep) < 1.5)"""


@query(NEAR + " SELECT * FROM pair", "event")
def event_pairs_box(s, d):
    return R.event_pairs(A.catalog(s, d), PAIR_T)


SHARED = ", sets AS (SELECT event_id, list_distinct(list(net_sta)) AS st FROM phase GROUP BY event_id), shared AS (SELECT evid1, evid2, CAST(len(list_intersect(a.st, b.st)) AS BIGINT) AS n_sta FROM pair JOIN sets a ON a.event_id = evid1 JOIN sets b ON b.event_id = evid2 WHERE len(list_intersect(a.st, b.st)) >= 2)"


@query(NEAR + SHARED + " SELECT * FROM shared", "phase")
def shared_station_pairs(s, d):
    return pairs.shared_stations(A.catalog(s, d), A.phases(s, d), PAIR_T, 2)


@query(NEAR + f", bth AS (SELECT evid1, evid2 FROM pair UNION ALL SELECT evid2, evid1 FROM pair), dd AS (SELECT evid1, evid2, round(sqrt(pow(111.0 * (a.lon - b.lon) * cos(a.lat * {RAD!r}), 2) + pow(111.0 * (a.lat - b.lat), 2) + pow(a.dep - b.dep, 2)), 6) AS dist FROM bth JOIN event a ON a.event_id = evid1 JOIN event b ON b.event_id = evid2) SELECT * FROM (SELECT evid1, evid2, dist, rank() OVER (PARTITION BY evid1 ORDER BY dist) AS rk FROM dd) WHERE rk <= 5", "event")
def nearest_k_ties(s, d):
    return pairs.nearest_pairs(A.catalog(s, d), PAIR_T, PAIR_T.max_nbr)


@query("SELECT event_id, net_sta, seq, tp_us FROM phase QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tp_us, net_sta, seq) <= 3", "phase")
def earliest_k_picks(s, d):
    return R.earliest_picks(A.phases(s, d), 3).select("event_id", "net_sta", "seq", "tp_us")


DT = ", dt AS (SELECT a.event_id AS evid1, a.event_id // 4 * 4 + (a.event_id + 1) % 4 AS evid2, net_sta AS sta, CASE WHEN seq % 2 = 0 THEN 'P' ELSE 'S' END AS phase, (a.tp_us % 1000 * 7 + seq * 137) % 2000 / 1000.0 - 1 AS dt, 0.3 + (seq * 31 + a.event_id * 17) % 70 / 100.0 AS weight FROM phase a)"


def _dt(s, d):
    e, q = F.col("event_id"), F.col("seq")
    return A.phases(s, d).select(e.alias("evid1"), (F.floor(e / 4).cast("long") * 4 + (e + 1) % 4).alias("evid2"), F.col("net_sta").alias("sta"), F.when(q % 2 == 0, "P").otherwise("S").alias("phase"), (((F.col("tp_us") % 1000 * 7 + q * 137) % 2000).cast("double") / 1000 - 1).alias("dt"), (F.lit(0.3) + ((q * 31 + e * 17) % 70).cast("double") / 100).alias("weight"))


def _km(a: str, b: str, ref: str) -> str:
    return f"sqrt(pow(111.0 * ({a}.lon - {b}.lon) * cos(({ref}) * {RAD!r}), 2) + pow(111.0 * ({a}.lat - {b}.lat), 2))"


SELECTED = DT + f""", sel AS (SELECT evid1, evid2, d.sta, phase, dt, weight FROM dt d JOIN event a ON a.event_id = evid1 JOIN event b ON b.event_id = evid2 JOIN station s ON s.net_sta = d.sta
 WHERE {_km("a", "b", "(a.lat + b.lat) / 2")} < 40 AND abs(a.dep - b.dep) < 5 AND least({_km("a", "s", "(a.lat + s.lat) / 2")}, {_km("b", "s", "(b.lat + s.lat) / 2")}) <= 120 AND weight * weight >= 0.3 AND abs(dt) <= CASE WHEN phase = 'P' THEN 0.5 ELSE 0.8 END)"""


@query(SELECTED + " SELECT evid1, evid2, sta, phase, round(dt, 6) AS dt, round(weight, 6) AS weight FROM sel", "phase")
def dt_select(s, d):
    return R.select_dt(_dt(s, d), A.catalog(s, d), A.stations(s, d), PAIR_T).select("evid1", "evid2", "sta", "phase", F.round("dt", 6).alias("dt"), F.round("weight", 6).alias("weight"))


@query(SELECTED + " SELECT evid1, evid2, count(DISTINCT sta) AS n_sta FROM sel GROUP BY ALL HAVING count(DISTINCT sta) >= 2", "phase")
def min_station_pairs(s, d):
    return R.pairs_with_stations(R.select_dt(_dt(s, d), A.catalog(s, d), A.stations(s, d), PAIR_T), 2)


@query(NEAR + ", long AS (SELECT event_id, net_sta AS sta, 'P' AS ph, min(tp_us - ot_us) AS tt FROM phase GROUP BY ALL UNION ALL SELECT event_id, net_sta, 'S', min(ts_us - ot_us) FROM phase GROUP BY ALL), obs AS (SELECT evid1, evid2, a.sta, a.ph AS phase, a.tt AS tt1, b.tt AS tt2, count(*) OVER (PARTITION BY evid1, evid2) AS links, row_number() OVER (PARTITION BY evid1, evid2 ORDER BY a.tt, a.sta, a.ph) AS rk FROM pair JOIN long a ON a.event_id = evid1 JOIN long b ON b.event_id = evid2 AND b.sta = a.sta AND b.ph = a.ph) SELECT evid1, evid2, sta, phase, tt1, tt2 FROM obs WHERE links >= 2 AND rk <= 6", "phase")
def catalog_dt(s, d):
    """X2."""
    return pairs.catalog_dt(A.catalog(s, d), A.phases(s, d), PAIR_T, 2, 6)


PROB = ", pr AS (SELECT event_id, event_type AS net_sta, tp_us, ts_us, (event_id * 37 % 50 + 50) / 100.0 AS p_prob, (event_id * 53 % 50 + 50) / 100.0 AS s_prob FROM pick)"


@query(PROB + " SELECT event_id, net_sta, tp_us FROM pr o WHERE NOT EXISTS (SELECT 1 FROM pr n WHERE n.net_sta = o.net_sta AND abs(n.tp_us - o.tp_us) < 3000000 AND abs(n.ts_us - o.ts_us) < 3000000 AND n.p_prob + n.s_prob > o.p_prob + o.s_prob)", "pick")
def merge_neighbour_picks(s, d):
    e = F.col("event_id")
    p = A.picks(s, d).select("event_id", F.col("event_type").alias("net_sta"), "tp_us", "ts_us", ((e * 37 % 50 + 50).cast("double") / 100).alias("p_prob"), ((e * 53 % 50 + 50).cast("double") / 100).alias("s_prob"))
    return R.merge_neighbours(p, 3_000_000, 3_000_000).select("event_id", "net_sta", "tp_us")


@query("SELECT a.w AS window_id, a.i AS p_idx, b.i AS s_idx FROM (SELECT tp_us // 20000000 AS w, tp_us // 100000 % 200 AS i FROM pick WHERE event_id % 2 = 0) a JOIN (SELECT tp_us // 20000000 AS w, tp_us // 100000 % 200 AS i FROM pick WHERE event_id % 2 = 1) b ON a.w = b.w AND b.i > a.i", "pick")
def ps_candidate_pairs(s, d):
    t = F.col("tp_us")
    det = A.picks(s, d).select(F.floor(t / 20_000_000).cast("long").alias("window_id"), F.when(F.col("event_id") % 2 == 0, "P").otherwise("S").alias("phase"), (F.floor(t / 100_000) % 200).cast("long").alias("idx"), F.lit(1.0).alias("prob"))
    return R.candidate_pairs(det).select("window_id", "p_idx", "s_idx")


LABEL = """SELECT sample_id, list_transform(range(0, 196), lambda i: CASE WHEN i >= s0 AND i < s2 THEN 2 WHEN i >= p0 AND i < p1 THEN 1 ELSE 0 END) AS t FROM (SELECT *, CASE WHEN s1 <= p0 THEN p0 + (p1 - p0) // 2 ELSE s1 END AS s0 FROM
 (SELECT event_id AS sample_id, CASE WHEN tp < 0.5 THEN 0 ELSE CAST(trunc(round((tp - 0.5) / 0.1, 6)) AS INT) + 1 END AS p0, CAST(trunc(round(tp / 0.1, 6)) AS INT) + 1 AS p1, CAST(trunc(round((ts - 0.5) / 0.1, 6)) AS INT) + 1 AS s1, CAST(trunc(round(ts / 0.1, 6)) AS INT) + 1 AS s2 FROM (SELECT event_id, (event_id * 13 % 1200) / 100.0 AS tp, (event_id * 13 % 1200) / 100.0 + (event_id % 7) * 0.1 + 0.05 AS ts FROM events)))"""


@query(f"SELECT sample_id, array_to_string(t, '') AS target FROM ({LABEL})")
def step_labels(s, d):
    e = F.col("event_id")
    tp = (e * 13 % 1200).cast("double") / 100
    rows = A.read(s, d, "events").select(e.alias("sample_id"), tp.alias("tp"), (tp + (e % 7) * F.lit(0.1) + 0.05).alias("ts"))
    return R.step_labels(rows, NEURAL).select("sample_id", F.array_join(F.col("target").cast("array<string>"), "").alias("target"))


@query("SELECT trace_id, CAST(st AS INT) AS step, round(list_sum(data[st * 4 + 1:st * 4 + 16]), 5) AS total, CAST(len(data[st * 4 + 1:st * 4 + 16]) AS BIGINT) AS n FROM trace, (SELECT unnest(range(0, 13)) AS st)", "trace")
def unfold_steps(s, d):
    return R.unfold(A.traces(s, d), 16, 4).select("trace_id", "step", F.round(R.total(F.col("seq")), 5).alias("total"), F.size("seq").cast("long").alias("n"))


@query("SELECT trace_id, round(list_max(data) - list_min(data), 6) AS ptp FROM trace", "trace")
def peak_to_peak(s, d):
    return A.traces(s, d).select("trace_id", F.round(R.peak_to_peak(F.col("data")), 6).alias("ptp"))


@query("SELECT trace_id, round(sqrt(list_sum(list_transform(data, lambda x: x * x))), 6) AS norm FROM trace", "trace")
def window_norm(s, d):
    return A.traces(s, d).select("trace_id", F.round(F.sqrt(R.total(F.transform("data", lambda x: x * x))), 6).alias("norm"))


@query("SELECT trace_id, k - 1 AS k, round(CASE WHEN m = 0 THEN 0 ELSE z[k] / m END, 6) AS v FROM (SELECT trace_id, z, list_max(list_transform(z, lambda x: abs(x))) AS m FROM (SELECT trace_id, list_transform(data, lambda x: x - list_avg(data)) AS z FROM trace)), (SELECT unnest(range(1, 65)) AS k)", "trace")
def trace_demean_norm(s, d):
    z = A.traces(s, d).withColumn("z", R.demeaned(F.col("data")))
    return z.select("trace_id", F.posexplode(R.max_normalised(F.col("z"))).alias("k", "v")).select("trace_id", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


@query("WITH t AS (SELECT vec_id AS trace_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), y AS (SELECT label, arg_min(CAST(embedding AS DOUBLE[])[17:48], vec_id) AS y FROM embeddings GROUP BY label), c AS (SELECT trace_id, list_transform(range(0, 33), lambda k: round(CASE WHEN list_dot_product(x[k + 1:k + 32], x[k + 1:k + 32]) = 0 THEN 0 ELSE list_dot_product(x[k + 1:k + 32], y) / (sqrt(list_dot_product(x[k + 1:k + 32], x[k + 1:k + 32])) * sqrt(list_dot_product(y, y))) END, 9)) AS cc FROM t JOIN embeddings e ON e.vec_id = trace_id JOIN y ON y.label = e.label) SELECT trace_id, round(list_max(cc), 6) AS cc, CAST(list_position(cc, list_max(cc)) - 1 AS BIGINT) AS lag FROM c")
def xcorr_max(s, d):
    t = A.traces(s, d)
    y = t.groupBy("label").agg(F.min_by(F.slice("data", 17, 32), "trace_id").alias("y"))
    cc, lag = R.correlation_max(F.col("data"), F.col("y"), 64, 32, False)
    return t.join(y, "label").select("trace_id", F.round(cc, 6).alias("cc"), lag.alias("lag"))


@query("SELECT trace_id, round(sqrt(list_max(list_transform(range(1, 65), lambda k: pow(list_sum(list_transform(data[1:k], lambda x: x - list_avg(data))) / 100, 2)))), 6) AS amp FROM trace", "trace")
def s_amplitude(s, d):
    """G7 on one component: the largest displacement."""
    z = R.demeaned(F.col("data"))
    t = A.traces(s, d).withColumn("z", z)
    disp = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.abs(R.total(F.slice("z", F.lit(1), k)) / 100))
    return t.select("trace_id", F.round(F.array_max(disp), 6).alias("amp"))


@query("SELECT trace_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS peak FROM (SELECT trace_id, list_transform(range(0, 32), lambda k: round(pow(list_sum(list_transform(range(0, 64), lambda i: data[i + 1] * cos(2 * pi() * k * i / 64))), 2) + pow(list_sum(list_transform(range(0, 64), lambda i: data[i + 1] * sin(2 * pi() * k * i / 64))), 2), 6)) AS p FROM trace)", "trace")
def dominant_freq(s, d):
    """The strongest bin of the first half of the spectrum (by definition; kernels use the FFT)."""
    import math

    wave = lambda f, k: F.round(F.pow(R.total(F.zip_with("data", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: f(k * i * F.lit(2 * math.pi / 64))), lambda a, b: a * b)), F.lit(2.0)), 9)
    power = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.round(wave(F.cos, k) + wave(F.sin, k), 6))
    return A.traces(s, d).withColumn("p", power).select("trace_id", (F.array_position("p", F.array_max("p")) - 1).cast("long").alias("peak"))


@query("SELECT event_id, strftime(make_timestamp(ot_us), '%Y-%m-%dT%H:%M:%S.%fZ') || ',' || printf('%.3f,%.3f,%.1f', lat, lon, dep) AS line FROM event", "event")
def format_lines(s, d):
    """K3."""
    return A.catalog(s, d).select("event_id", F.concat(X.iso_text(F.col("ot_us")), F.format_string(",%.3f,%.3f,%.1f", "lat", "lon", "dep")).alias("line"))


@query("SELECT e.event_id, p.net_sta, p.seq, p.tp_us FROM event e JOIN phase p USING (event_id)", "phase")
def phase_header_fill(s, d):
    """R7 on text made of the tables: header lines and pick lines in files of 1,000 events, put apart again."""
    from ..sources.phases import split_phase_lines
    from ..sources.writers import PER_EVENT, phase_lines

    lines = phase_lines(A.catalog(s, d), A.phases(s, d).withColumn("net_sta", F.concat_ws("|", "net_sta", "seq")), with_id=True)
    file = F.floor(F.col("line_no") / (1000 * PER_EVENT)).cast("string")
    head, ph = split_phase_lines(lines.select(file.alias("file"), "line_no", "line"), keep_duplicates=True)
    both = ph.join(head.select("file", "event_no", F.col("evid").cast("long").alias("event_id")), ["file", "event_no"])
    return both.select("event_id", F.split_part("net_sta", F.lit("|"), F.lit(1)).alias("net_sta"), F.split_part("net_sta", F.lit("|"), F.lit(2)).cast("int").alias("seq"), "tp_us")


@query("SELECT event_id AS evid, round(lat, 4) AS lat, round(dep, 1) AS dep, (event_id % 3 <> 0) AS is_loc FROM event", "event")
def fixed_width_sum_parse(s, d):
    """R13 on text made of the catalog."""
    from ..sources.location import parse_summary

    deg = F.floor("lat").cast("int")
    lon = F.abs("lon")
    ldeg = F.floor(lon).cast("int")
    line = F.concat(F.rpad(F.lit("20190704 1734 10.00"), 20, " "), F.format_string("%2d %5.2f", deg, (F.col("lat") - deg) * 60), F.lit(" "), F.format_string("%3d %5.2f", ldeg, (lon - ldeg) * 60), F.format_string("%7.2f", "dep"), F.rpad(F.lit(""), 7, " "), F.lit(" 10"), F.lit(" 100"), F.rpad(F.lit(""), 5, " "), F.lit(" 0.10"), F.rpad(F.lit(""), 11, " "), F.lit("B"), F.when(F.col("event_id") % 3 == 0, " - ").otherwise("   "), F.format_string("%d", "event_id"))
    got = parse_summary(A.catalog(s, d).select(line.alias("line")))
    return got.select("evid", F.round("lat", 4).alias("lat"), F.round("dep_full", 1).alias("dep"), "is_loc")
