"""Waveform files of a day directory: listing, SAC decoding, windows by time."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "path string, net_sta string, chn int, start_us long, rate double, npts int, data array<float>"
UNSET = -12345.0


def list_day(spark: SparkSession, folder: str, single: bool = False) -> DataFrame:
    """(net_sta, paths) of a day's folder, paths sorted; stations without exactly 3 files are left out, or, with single, get their last path three times."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*.*").load(folder).select("path")  # contents are not read
    name = F.element_at(F.split("path", "/"), -1)
    own = files.select(F.concat_ws(".", F.split_part(name, F.lit("."), F.lit(1)), F.split_part(name, F.lit("."), F.lit(2))).alias("net_sta"), "path")
    by = own.groupBy("net_sta").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    if single:
        return by.withColumn("paths", F.when(F.size("paths") == 3, F.col("paths")).otherwise(F.array_repeat(F.element_at("paths", -1), 3)))
    return by.where(F.size("paths") == 3)


def decode_sac(raw: bytes) -> tuple[int, float, np.ndarray] | None:
    """(start_us, rate, samples) of a SAC file of either byte order; None where it is none."""
    if len(raw) < 632:
        return None
    for order in "<>":
        version = struct.unpack_from(order + "i", raw, 304)[0]
        if version in (6, 7):
            delta, begin = (struct.unpack_from(order + "f", raw, 4 * i)[0] for i in (0, 5))
            year, day, hour, minute, sec, msec = struct.unpack_from(order + "6i", raw, 280)
            npts = struct.unpack_from(order + "i", raw, 316)[0]
            data = np.frombuffer(raw, dtype=order + "f4", offset=632)[: max(0, npts)]
            if npts < 0 or len(data) < npts or not delta > 0 or year < 1:
                return None
            at = pd.Timestamp(year=year, month=1, day=1) + pd.Timedelta(days=day - 1, hours=hour, minutes=minute, seconds=sec, milliseconds=msec)
            return at.value // 1000 + round((begin if begin != UNSET else 0.0) * 1e6), round(1 / delta, 4), data.astype("f4")
    return None


def encode_sac(start_us: int, rate: float, data: np.ndarray, t0: float = UNSET, t1: float = UNSET) -> bytes:
    """A SAC file, P and S times relative to the start in t0 and t1; milliseconds are truncated."""
    at = pd.Timestamp(start_us, unit="us")
    f = np.full(70, UNSET, dtype="<f4")
    f[0], f[5], f[6], f[10], f[11] = 1 / rate, 0.0, (len(data) - 1) / rate, t0, t1
    i = np.full(40, int(UNSET), dtype="<i4")
    i[:6] = at.year, at.dayofyear, at.hour, at.minute, at.second, at.microsecond // 1000
    i[6], i[9], i[15], i[35:40] = 6, len(data), 1, (1, 1, 1, 1, 0)
    return f.tobytes() + i.tobytes() + (b"-12345  " * 24) + np.asarray(data, dtype="<f4").tobytes()


def read_traces(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each SAC file; one that can't be decoded has null data (its station is then left out by the picker)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf.path, pdf.content, strict=True):
                name = path.rsplit("/", 1)[-1].split(".")
                got = decode_sac(bytes(raw))
                rows.append((path, ".".join(name[:2]), None, *(got[:2] if got else (None, None)), len(got[2]) if got else None, got[2] if got else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRACE.split(", ")])

    from pyspark.sql import Window

    raw = spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, TRACE)
    return raw.withColumn("chn", (F.row_number().over(Window.partitionBy("net_sta").orderBy("path")) - 1).cast("int"))


def with_gain(traces: DataFrame, gains: DataFrame) -> DataFrame:
    """Data over the channel's gain of the interval that holds the trace's centre, else of the last one."""
    from ..operators.relational import gain_at

    mid = traces.withColumn("mid_us", F.col("start_us") + F.floor(F.col("npts") / F.col("rate") * 500_000).cast("long")).withColumn("trace_id", F.col("path"))
    each = gains.select("net_sta", "ord", "t0_us", "t1_us", F.struct("ge", "gn", "gz").alias("gain"))
    found = gain_at(mid.select("trace_id", "net_sta", "mid_us"), each).select(F.col("trace_id").alias("path"), "gain")
    g = F.when(F.col("chn") == 0, F.col("gain.ge")).when(F.col("chn") == 1, F.col("gain.gn")).otherwise(F.col("gain.gz"))
    return traces.join(found, "path").withColumn("data", F.transform("data", lambda x: (x / g).cast("float"))).drop("gain")


def chunked(traces: DataFrame, seconds: int = 600) -> DataFrame:
    """Traces in chunks (chunk_us: its start), so a time range reads few of them once written by day and sorted."""
    n = (F.lit(seconds) * F.col("rate")).cast("int")
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("data") - 1) / n).cast("int")), lambda i: F.struct((F.col("start_us") + F.round(i * n / F.col("rate") * 1_000_000).cast("long")).alias("chunk_us"), F.slice("data", i * n + 1, n).alias("part"))))
    return traces.where(F.size("data") > 0).select("net_sta", "chn", "rate", parts.alias("x")).select("net_sta", "chn", "rate", "x.chunk_us", F.col("x.part").alias("data"))


def cut_windows(chunks: DataFrame, windows: DataFrame, seconds: int = 600) -> DataFrame:
    """Windows (window_id, net_sta, t0_us, t1_us) out of chunks: (window_id, chn, start_us, data) where all samples are there.

    A window meets the chunks of its time by equal chunk numbers; no chunk is read for a
    station without windows.
    """
    width = seconds * 1_000_000
    number = F.floor(F.col("chunk_us") / width)
    w = windows.withColumn("k", F.explode(F.sequence(F.floor(F.col("t0_us") / width) - 1, F.floor(F.col("t1_us") / width))))
    met = chunks.withColumn("k", number).join(w, ["net_sta", "k"])
    step = 1e6 / F.col("rate")
    lo = F.greatest(F.lit(0), F.round((F.col("t0_us") - F.col("chunk_us")) / step).cast("int"))
    hi = F.least(F.size("data"), F.round((F.col("t1_us") - F.col("chunk_us")) / step).cast("int"))
    part = met.where(hi > lo).select("window_id", "net_sta", "chn", "rate", "t0_us", "t1_us", (F.col("chunk_us") + F.round(lo * step).cast("long")).alias("at"), F.slice("data", lo + 1, hi - lo).alias("part"))
    whole = part.groupBy("window_id", "net_sta", "chn", "rate", "t0_us", "t1_us").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p"))
    out = whole.select("window_id", "net_sta", "chn", "rate", F.element_at("p", 1)["at"].alias("start_us"), F.flatten(F.transform("p", lambda x: x["part"])).alias("data"), F.round((F.col("t1_us") - F.col("t0_us")) * F.col("rate") / 1_000_000).cast("int").alias("n"))
    return out.where(F.size("data") == F.col("n")).drop("n")


def missing_days(stations: DataFrame, present: DataFrame, first: str, last: str) -> DataFrame:
    """R21, R22 (planning alone; nothing is fetched): station-days of first <= day < last without three files in present (net_sta, day)."""
    days = stations.select("net_sta", F.explode(F.sequence(F.to_date(F.lit(first)), F.date_sub(F.to_date(F.lit(last)), 1))).alias("day"))
    full = present.groupBy("net_sta", "day").count().where("count >= 3")
    return days.join(full, ["net_sta", "day"], "left_anti")
