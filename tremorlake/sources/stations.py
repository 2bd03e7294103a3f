"""Station files: places and gains in three layouts, by the number of fields after the elevation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import parse_time
from .phases import read_lines


def parse_stations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations, gains) of lines (file, line_no, line).

    One trailing field: a gain for all channels; three: E, N, Z; five: E, N, Z, start, end.
    Lines with other counts are left out. stations: the first line of each station;
    gains: net_sta, ord (1, 2, ...), ge, gn, gz, t0_us, t1_us.
    """
    f = F.transform(F.split("line", ","), lambda x: F.trim(x))
    own = lines.withColumn("f", f).withColumn("n", F.size("f") - 4).where("n in (1, 3, 5)")
    num = lambda i: F.get("f", F.lit(i)).try_cast("double")
    one = F.col("n") == 1
    rows = own.select(
        F.get("f", F.lit(0)).alias("net_sta"),
        "line_no",
        num(1).alias("lat"),
        num(2).alias("lon"),
        num(3).alias("ele"),
        num(4).alias("ge"),
        F.when(one, num(4)).otherwise(num(5)).alias("gn"),
        F.when(one, num(4)).otherwise(num(6)).alias("gz"),
        F.when(F.col("n") == 5, parse_time(F.regexp_replace(F.get("f", F.lit(7)), "/", "-"))).alias("t0_us"),
        F.when(F.col("n") == 5, parse_time(F.regexp_replace(F.get("f", F.lit(8)), "/", "-"))).alias("t1_us"),
    )
    stations = rows.groupBy("net_sta").agg(F.min_by(F.struct("lat", "lon", "ele"), "line_no").alias("x")).select("net_sta", "x.*")
    listed = rows.groupBy("net_sta").agg(F.sort_array(F.collect_list(F.struct("line_no", "ge", "gn", "gz", "t0_us", "t1_us"))).alias("g"))
    gains = listed.select("net_sta", F.posexplode("g").alias("ord", "g")).select("net_sta", (F.col("ord") + 1).alias("ord"), "g.ge", "g.gn", "g.gz", "g.t0_us", "g.t1_us")
    return stations, gains


def read_stations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_stations(read_lines(spark, path))


def with_bare_names(stations: DataFrame) -> DataFrame:
    """Stations by NET.STA and by bare STA (the first NET.STA of a STA wins)."""
    bare = stations.withColumn("sta", F.split_part("net_sta", F.lit("."), F.lit(2)))
    first = bare.groupBy("sta").agg(F.min_by(F.struct("lat", "lon", "ele"), "net_sta").alias("x")).where("sta <> ''").select(F.col("sta").alias("name"), "x.*")
    return stations.select(F.col("net_sta").alias("name"), "lat", "lon", "ele").unionByName(first)
