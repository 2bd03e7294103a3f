"""Domain tables over the star-schema test tables, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import micros
from ..params import Association

P = Association()
RATIO = (1 / P.vp) / (1 / P.vs - 1 / P.vp)
DAY = 86_400_000_000


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(
        F.concat(F.lit("N"), "s_nationkey", F.lit(".S"), k).alias("net_sta"),
        (35 + ((k * 37) % 100).cast("double") / 100).alias("lat"),
        (-118 + ((k * 53) % 100).cast("double") / 100).alias("lon"),
        (F.abs("s_acctbal") % 2000.0).alias("ele"),
        k.alias("sta_id"),
        "s_nationkey",
    )


def picks(spark: SparkSession, d: str) -> DataFrame:
    """Picks from events; one of ten is at a station that does not exist, some have S before P."""
    e = read(spark, d, "events")
    sta = stations(spark, d).select("sta_id", "net_sta")
    n = read(spark, d, "supplier").agg(F.count("*").alias("n_sta"))
    own = e.join(F.broadcast(n)).select("event_id", "user_id", "event_type", F.floor(micros(F.col("ts")) / 100).cast("long").alias("tp_us"), "value", ((F.col("user_id") % F.col("n_sta")) + 1).alias("sta_id"))
    unknown = F.concat(F.lit("X.U"), F.col("user_id"))
    own = own.join(sta, "sta_id", "left").withColumn("net_sta", F.when(F.col("event_id") % 10 == 9, unknown).otherwise(F.coalesce("net_sta", unknown)))
    ts = F.col("tp_us") + ((F.col("event_id") % 7) - F.when(F.col("event_id") % 23 == 0, 9).otherwise(0) + 1) * 500_000
    return own.select("event_id", "net_sta", "tp_us", ts.alias("ts_us"), (F.col("value") * 1e-6).alias("s_amp"), "event_type")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        k.alias("event_id"),
        (micros(F.col("o_orderdate")) + (k * 7919) % 86400 * 1_000_000).alias("ot_us"),
        (35 + ((k * k * 37 + k * 11) % 1000).cast("double") / 500).alias("lat"),
        (-118 + ((k * k * 53 + k * 29) % 997).cast("double") / 500).alias("lon"),
        (((k * k * 11 + k * 7) % 199).cast("double") / 10).alias("dep"),
        (F.col("o_totalprice") / 100000).alias("mag"),
    )


def phases(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    ot = catalog(spark, d).select(F.col("event_id").alias("l_orderkey"), "ot_us")
    sta = stations(spark, d).select(F.col("sta_id").alias("l_suppkey"), "net_sta")
    tp = F.col("ot_us") + (F.col("l_quantity") * 100_000).cast("long")
    return li.join(ot, "l_orderkey").join(sta, "l_suppkey").select(F.col("l_orderkey").alias("event_id"), "net_sta", F.col("l_linenumber").alias("seq"), "ot_us", tp.alias("tp_us"), (tp + (F.col("l_quantity") * 70_000).cast("long")).alias("ts_us"), (F.col("l_extendedprice") * 1e-6).alias("s_amp"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(chn, idx, v, t_us): event values as five channels, in time order."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return read(spark, d, "events").select(F.col("event_type").alias("chn"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("value").alias("v"), F.floor(micros(F.col("ts")) / 100).cast("long").alias("t_us"))


def traces(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("trace_id"), "label", F.col("embedding").cast("array<double>").alias("data"))


SQL = {
    "station": """station AS (SELECT 'N' || s_nationkey || '.S' || s_suppkey AS net_sta, 35 + CAST((s_suppkey * 37) % 100 AS DOUBLE) / 100 AS lat,
 -118 + CAST((s_suppkey * 53) % 100 AS DOUBLE) / 100 AS lon, abs(s_acctbal) % 2000.0 AS ele, s_suppkey AS sta_id, s_nationkey FROM supplier)""",
    "pick": f"""pick AS (SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'X.U' || user_id ELSE coalesce(s.net_sta, 'X.U' || user_id) END AS net_sta, tp_us,
 tp_us + ((event_id % 7) - CASE WHEN event_id % 23 = 0 THEN 9 ELSE 0 END + 1) * 500000 AS ts_us, value * 1e-6 AS s_amp, event_type
 FROM (SELECT *, epoch_us(ts) // 100 AS tp_us, user_id % (SELECT count(*) FROM supplier) + 1 AS sid FROM events) e LEFT JOIN station s ON s.sta_id = e.sid),
 timed AS (SELECT *, tp_us - CAST(floor((ts_us - tp_us) * CAST({RATIO!r} AS DOUBLE)) AS BIGINT) AS sta_ot_us FROM pick)""",
    "event": """event AS (SELECT o_orderkey AS event_id, epoch_us(o_orderdate) + (o_orderkey * 7919) % 86400 * 1000000 AS ot_us, 35 + CAST((o_orderkey * o_orderkey * 37 + o_orderkey * 11) % 1000 AS DOUBLE) / 500 AS lat,
 -118 + CAST((o_orderkey * o_orderkey * 53 + o_orderkey * 29) % 997 AS DOUBLE) / 500 AS lon, CAST((o_orderkey * o_orderkey * 11 + o_orderkey * 7) % 199 AS DOUBLE) / 10 AS dep, o_totalprice / 100000 AS mag FROM orders)""",
    "phase": """phase AS (SELECT l_orderkey AS event_id, net_sta, l_linenumber AS seq, ot_us, ot_us + CAST(trunc(l_quantity * 100000) AS BIGINT) AS tp_us,
 ot_us + CAST(trunc(l_quantity * 100000) AS BIGINT) + CAST(trunc(l_quantity * 70000) AS BIGINT) AS ts_us, l_extendedprice * 1e-6 AS s_amp
 FROM lineitem JOIN event ON event_id = l_orderkey JOIN station ON sta_id = l_suppkey)""",
    "sample": """sample AS (SELECT event_type AS chn, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS v, epoch_us(ts) // 100 AS t_us FROM events)""",
    "trace": """trace AS (SELECT vec_id AS trace_id, label, CAST(embedding AS DOUBLE[]) AS data FROM embeddings)""",
}
NEEDS = {"pick": ["station"], "phase": ["event", "station"]}


def with_tables(names: str, query: str) -> str:
    """query after WITH clauses of the domain tables named."""
    order: list[str] = []
    for n in names.split():
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(SQL[x] for x in order) + "\n" + query
