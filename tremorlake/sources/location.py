"""Outputs of location and relocation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_summary(lines: DataFrame, ground: float = 0.0, lat_code: str = "N", lon_code: str = "W") -> DataFrame:
    """Location candidates of fixed-width lines (line).

    dep is read without its second decimal, as catalogs of this format were made (Q1);
    dep_full has it. is_loc: no token is - or #.
    """
    t = F.split(F.trim("line"), r"\s+")
    num = lambda pos, n: F.trim(F.substring("line", pos, n)).try_cast("double")
    lat, lon = num(21, 2) + num(24, 5) / 60, num(30, 3) + num(33 + 1, 5) / 60
    return lines.withColumn("t", t).select(
        F.element_at("t", -1).try_cast("long").alias("evid"),
        F.get("t", F.lit(0)).alias("date"),
        F.get("t", F.lit(1)).alias("hhmm"),
        F.get("t", F.lit(2)).alias("sec"),
        (lat if lat_code == "N" else -lat).alias("lat"),
        (lon if lon_code == "E" else -lon).alias("lon"),
        (num(39, 6) + ground).alias("dep"),
        (num(39, 7) + ground).alias("dep_full"),
        num(53, 3).cast("int").alias("npha"),
        num(57, 3).alias("azm"),
        num(65, 5).alias("rms"),
        F.substring("line", 81, 1).alias("qua"),
        (~F.array_contains("t", "-") & ~F.array_contains("t", "#")).alias("is_loc"),
        "line",
    )


def read_summary(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Candidates of the files of all trial depths (a glob); cand numbers an event's candidates by file and place."""
    from .phases import read_lines

    lines = read_lines(spark, path)
    return parse_summary(lines, **kw).join(lines, "line").withColumn("cand", F.concat_ws(":", "file", F.lpad("line_no", 9, "0"))).drop("file", "line_no", "line").distinct()


def parse_relocations(lines: DataFrame) -> DataFrame:
    """(evid, lat, lon, dep, ot_us) of whitespace-separated lines (line); second 60.000 counts as 59.999; rows whose depth or time is no number are left out."""
    f = F.split(F.trim("line"), r"\s+")
    get = lambda i: F.get(f, F.lit(i))
    num = lambda i: get(i).try_cast("double")
    sec = F.when(get(15) == "60.000", 59.999).otherwise(num(15))
    t = F.try_make_timestamp_ntz(*[get(i).try_cast("int") for i in range(10, 15)], sec.cast("decimal(16,6)"))
    return lines.select(get(0).try_cast("long").alias("evid"), num(1).alias("lat"), num(2).alias("lon"), num(3).alias("dep"), F.unix_micros(t.cast("timestamp")).alias("ot_us")).where("evid is not null and dep is not null and ot_us is not null")


def read_relocations(spark: SparkSession, path: str) -> DataFrame:
    return parse_relocations(spark.read.text(path).select(F.col("value").alias("line")).where("trim(value) <> ''"))


def read_velocity_model(spark: SparkSession, path: str) -> DataFrame:
    """(top, velocity) of a title line and `velocity depth` lines."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(f, F.lit(1)).try_cast("double").alias("top"), F.get(f, F.lit(0)).try_cast("double").alias("velocity")).where("top is not null and velocity is not null")


def latest_checkpoint(paths: list[str], index: int = -1) -> str | None:
    """The checkpoint `<index>_*.ckpt`, -1 for the largest index; the first by name where an index has several."""
    import os
    import re

    own = [(int(m[1]), p) for p in paths if (m := re.match(r"(\d+)_.*\.ckpt$", os.path.basename(p)))]
    if index < 0 and own:
        index = max(own)[0]
    return min((p for i, p in own if i == index), default=None)
