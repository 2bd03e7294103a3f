"""Registered queries on the text formats: what writers make of the test tables, readers give back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import neural
from ..operators import relational as R
from ..sources import location, phases, picks, stations, writers
from . import adapters as A
from . import catalog_queries as C

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str, tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = A.with_tables(tables, sql) if tables else sql
        return f

    return add


def _folder(s: SparkSession) -> str:
    """A new folder in the shared warehouse."""
    return f"{s.conf.get('spark.sql.warehouse.dir').rstrip('/')}/text_{uuid.uuid4().hex}"


def _timed(s: SparkSession, d: str) -> DataFrame:
    return R.with_origin_time(A.picks(s, d), C.ASSOC.vp, C.ASSOC.vs)


QUALITY = {"p_snr": (37, 500), "fd": (11, 90), "amp_ratio": (7, 40), "a12": (13, 60), "a13": (17, 70)}


@query("SELECT net_sta, sta_ot_us, tp_us, ts_us, s_amp, " + ", ".join(f"(event_id * {a} % {b}) / 10.0 AS {n}" for n, (a, b) in QUALITY.items()) + " FROM timed", "pick")
def rule_pick_files(s, d):
    """K1, R5."""
    rows = _timed(s, d).withColumns({n: (F.col("event_id") * a % b).cast("double") / 10 for n, (a, b) in QUALITY.items()})
    path = _folder(s)
    writers.write_lines(writers.pick_lines(rows), path, "line")
    return picks.read_picks(s, path).select("net_sta", "sta_ot_us", "tp_us", "ts_us", "s_amp", *QUALITY)


NN_RATIO = (1 / 6.0) / (1 / 3.45 - 1 / 6.0)


@query(f"SELECT net_sta, tp_us, ts_us, tp_us - CAST(floor((ts_us - tp_us) * CAST({NN_RATIO!r} AS DOUBLE)) AS BIGINT) AS sta_ot_us, s_amp, (event_id * 37 % 50 + 50) / 100.0 AS p_prob, (event_id * 53 % 50 + 50) / 100.0 AS s_prob FROM pick", "pick")
def neural_pick_files(s, d):
    """K2, R6."""
    e = F.col("event_id")
    rows = A.picks(s, d).withColumn("p_prob", (e * 37 % 50 + 50).cast("double") / 100).withColumn("s_prob", (e * 53 % 50 + 50).cast("double") / 100)
    path = _folder(s)
    writers.write_lines(writers.neural_pick_lines(rows), path, "line")
    return picks.read_neural_picks(s, path).select("net_sta", "tp_us", "ts_us", "sta_ot_us", "s_amp", "p_prob", "s_prob")


@query("SELECT net_sta, lat, lon, ele, ord, ge, gz FROM station, (SELECT unnest([1, 2]) AS ord), LATERAL (SELECT sta_id * 10.0 + ord AS ge, CASE WHEN sta_id % 2 = 0 THEN sta_id * 10.0 + ord ELSE sta_id * 10.0 + ord + 0.5 END AS gz)", "station")
def station_files(s, d):
    """Two lines a station, of the layout with one gain or with three."""
    gain = F.col("sta_id") * F.lit(10.0) + F.col("ord")
    own = A.stations(s, d).withColumn("ord", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("g", gain)
    fields = F.concat_ws(", ", "net_sta", *[F.col(c).cast("string") for c in ("lat", "lon", "ele", "g")])
    line = F.when(F.col("sta_id") % 2 == 0, fields).otherwise(F.concat_ws(",", fields, F.col("g").cast("string"), (F.col("g") + 0.5).cast("string")))
    sta, gains = stations.parse_stations(own.select(F.lit("f").alias("file"), (F.col("sta_id") * 2 + F.col("ord")).alias("line_no"), line.alias("line")))
    return sta.join(gains, "net_sta").select("net_sta", "lat", "lon", "ele", "ord", "ge", "gz")


@query("SELECT net_sta AS name, lat, lon, ele FROM station UNION ALL SELECT split_part(net_sta, '.', 2), arg_min(lat, net_sta), arg_min(lon, net_sta), arg_min(ele, net_sta) FROM station GROUP BY 1", "station")
def station_names(s, d):
    """R12, K9."""
    return stations.with_bare_names(A.stations(s, d))


@query("SELECT net_sta, rpad(split_part(net_sta, '.', 2), 6, ' ') || rpad(split_part(net_sta, '.', 1), 4, ' ') || 'BHZ  ' || printf('%2d %7.4f', CAST(floor(lat) AS INT), (lat - floor(lat)) * 60) || 'N ' || printf('%3d %7.4f', CAST(floor(-lon) AS INT), (-lon - floor(-lon)) * 60) || 'W' || printf('%4d', CAST(trunc(ele) AS INT)) AS line FROM station", "station")
def station_text(s, d):
    """K5."""
    return writers.station_lines(A.stations(s, d))


@query("SELECT event_id, printf('%-5s %9.4f 1.000 %s', split_part(net_sta, '.', 2), (CASE WHEN ph = 'P' THEN tp_us ELSE ts_us END - ot_us) / 1e6, ph) AS line FROM phase, (SELECT unnest(['P', 'S']) AS ph)", "phase")
def travel_time_text(s, d):
    """The rows below the headers."""
    return writers.travel_time_lines(A.catalog(s, d), A.phases(s, d)).where("part = 1").select("event_id", "line")


@query("SELECT event_id AS evid, lat, lon, dep, ot_us FROM event", "event")
def relocation_files(s, d):
    """R14."""
    t = F.timestamp_micros("ot_us")
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("event_id", "lat", "lon", "dep")], F.lit("0.0 0.0 0.0 1.0 1.0 1.0"), F.date_format(t, "yyyy MM dd HH mm ss.SSS"), F.lit("0.0"))
    return location.parse_relocations(A.catalog(s, d).select(line.alias("line")))


@query(C.DT + " SELECT evid1, evid2, sta, phase, round(dt, 5) AS dt, round(sqrt(weight), 4) AS weight FROM dt", "phase")
def differential_time_files(s, d):
    """Files of 1,000 first events."""
    lines = writers.differential_time_lines(C._dt(s, d).withColumnRenamed("weight", "cc"))
    file = F.floor(F.col("evid1") / 1000).cast("string").alias("file")
    order = Window.partitionBy("file").orderBy("evid1", "evid2", "part", "line")
    return phases.parse_differential_times(lines.select(file, "evid1", "evid2", "part", "line").withColumn("line_no", F.row_number().over(order)))


@query(f"SELECT event_id, ot_us FROM event WHERE ot_us > {8 * 365 * R.DAY_US} AND ot_us < {30 * 365 * R.DAY_US}", "event")
def event_time_range(s, d):
    """R10, F10."""
    return phases.between(A.catalog(s, d), 8 * 365 * R.DAY_US, 30 * 365 * R.DAY_US).select("event_id", "ot_us")


@query("""WITH t AS (SELECT event_id % 2 = 0 AS is_pos, list_transform(range(0, 8), lambda i: (event_id // 3 + i) % 3) AS pred, list_transform(range(0, 8), lambda i: (event_id // 7 + i) % 3) AS target FROM events), u AS (SELECT is_pos, list_sum(list_transform(range(1, 9), lambda i: CASE WHEN pred[i] = target[i] THEN 1 ELSE 0 END)) AS same, list_contains(pred, 1) AND list_contains(pred, 2) AS found FROM t)
 SELECT is_pos, count(*) AS n, round(sum(same) / (8.0 * count(*)), 6) AS step_acc, round(avg(CASE WHEN found = is_pos THEN 1.0 ELSE 0.0 END), 6) AS window_acc FROM u GROUP BY is_pos""", "")
def step_accuracy(s, d):
    """A14."""
    steps = lambda k: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.floor(F.col("event_id") / k) + i) % 3).cast("int"))
    rows = A.read(s, d, "events").select((F.col("event_id") % 2 == 0).alias("is_pos"), steps(3).alias("pred"), steps(7).alias("target"))
    return neural.accuracy(rows).select("is_pos", "n", F.round("step_acc", 6).alias("step_acc"), F.round("window_acc", 6).alias("window_acc"))
