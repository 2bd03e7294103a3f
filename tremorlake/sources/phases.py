"""Hierarchical text files: header lines followed by their rows.

A line's header is found with a running count of headers over line numbers, one window a
file, so files are read in parallel. Lines are read with their place in the file
(read_lines); no order of rows in a DataFrame is relied on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import parse_time


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files; a file is read as a whole, as catalogs are, and split on executors."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return raw.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where("line <> ''").select("file", F.col("line_no").cast("long").alias("line_no"), "line")


def is_header(line, rule: int | None = None):
    """A line is a header where its first field is a time or evid_name; rule: compatibility, where it has more characters than that."""
    first = F.split_part(line, F.lit(","), F.lit(1))
    if rule is not None:
        return F.length(first) > rule
    return parse_time(first).isNotNull() | first.rlike(r"^\d+_")


def split_phase_lines(lines: DataFrame, rule: int | None = None, keep_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, phases) of lines (file, line_no, line).

    events: file, event_no, evid and event_name (from `evid_name` first fields, or evid the
    sixth field), ot_us, lat, lon, dep, mag, num_pos (pick lines, all counted). phases:
    file, event_no, net_sta, tp_us, ts_us (-1 is null), s_amp; of a station's lines in an
    event the last stays, unless keep_duplicates.
    """
    own = lines.withColumn("head", is_header(F.col("line"), rule)).withColumn("f", F.split("line", ","))
    order = Window.partitionBy("file").orderBy("line_no")
    own = own.withColumn("event_no", F.sum(F.col("head").cast("int")).over(order)).where("event_no > 0")
    get = lambda i: F.trim(F.get("f", F.lit(i)))
    named = get(0).rlike(r"^\d+_")
    shift = lambda i: F.when(named, get(i + 1)).otherwise(get(i))
    num = lambda c: c.try_cast("double")
    count = own.groupBy("file", "event_no").agg(F.count_if(~F.col("head")).alias("num_pos"))
    events = own.where("head").select(
        "file",
        "event_no",
        F.when(named, F.split_part(get(0), F.lit("_"), F.lit(1))).otherwise(get(5)).alias("evid"),
        F.when(named, F.substring_index(get(0), "_", -1)).alias("event_name"),
        parse_time(shift(0)).alias("ot_us"),
        num(shift(1)).alias("lat"),
        num(shift(2)).alias("lon"),
        num(shift(3)).alias("dep"),
        num(shift(4)).alias("mag"),
    )
    rows = own.where("not head").select("file", "event_no", "line_no", get(0).alias("net_sta"), parse_time(get(1)).alias("tp_us"), parse_time(get(2)).alias("ts_us"), num(get(3)).alias("s_amp"))
    if keep_duplicates:
        phases = rows.drop("line_no")
    else:
        last = F.max_by(F.struct("tp_us", "ts_us", "s_amp"), "line_no").alias("x")
        phases = rows.groupBy("file", "event_no", "net_sta").agg(last).select("file", "event_no", "net_sta", "x.tp_us", "x.ts_us", "x.s_amp")
    return events.join(count, ["file", "event_no"]), phases


def read_phases(spark: SparkSession, path: str, rule: int | None = None) -> tuple[DataFrame, DataFrame]:
    return split_phase_lines(read_lines(spark, path), rule)


def between(events: DataFrame, lo_us: int, hi_us: int, inclusive: bool = False) -> DataFrame:
    """Events in a time range, ends left out unless inclusive."""
    return events.where(F.col("ot_us").between(lo_us, hi_us)) if inclusive else events.where((F.col("ot_us") > lo_us) & (F.col("ot_us") < hi_us))


def name_events(lines: DataFrame) -> DataFrame:
    """Evid of each header by its ordinal in file order, from 0, as number and name join keys."""
    events, _ = split_phase_lines(lines)
    return events.select("file", (F.col("event_no") - 1).alias("ordinal"), "event_name", "ot_us")


def parse_differential_times(lines: DataFrame) -> DataFrame:
    """(evid1, evid2, sta, phase, dt, weight) of lines (file, line_no, line) of dt.cc files."""
    own = lines.withColumn("f", F.split(F.trim("line"), r"\s+"))
    head = F.get("f", F.lit(0)) == "#"
    own = own.withColumn("pair", F.max(F.when(head, F.struct("line_no", F.get("f", F.lit(1)).try_cast("long").alias("a"), F.get("f", F.lit(2)).try_cast("long").alias("b")))).over(Window.partitionBy("file").orderBy("line_no")))
    get = lambda i: F.get("f", F.lit(i))
    return own.where(~head & F.col("pair").isNotNull()).select(F.col("pair.a").alias("evid1"), F.col("pair.b").alias("evid2"), get(0).alias("sta"), get(3).alias("phase"), get(1).try_cast("double").alias("dt"), get(2).try_cast("double").alias("weight"))


def read_differential_times(spark: SparkSession, path: str) -> DataFrame:
    return parse_differential_times(read_lines(spark, path))
