"""Text sinks: each makes a column of lines; write_lines writes them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import iso_text


def _time(us: Column) -> Column:
    return F.coalesce(iso_text(us), F.lit("-1"))


def pick_lines(picks: DataFrame) -> DataFrame:
    """K1: rule-based picks, quality with one decimal."""
    q = F.format_string("%.1f,%.1f,%.1f,%.1f,%.1f", "p_snr", "fd", "amp_ratio", "a12", "a13")
    return picks.select(F.concat_ws(",", "net_sta", _time(F.col("sta_ot_us")), _time(F.col("tp_us")), _time(F.col("ts_us")), F.col("s_amp").cast("string"), q).alias("line"))


def neural_pick_lines(picks: DataFrame) -> DataFrame:
    """K2: neural picks, probabilities with two decimals."""
    return picks.select(F.concat_ws(",", "net_sta", _time(F.col("tp_us")), _time(F.col("ts_us")), F.col("s_amp").cast("string"), F.format_string("%.2f,%.2f", "p_prob", "s_prob")).alias("line"))


def catalog_line() -> Column:
    """K3: a line of the catalog; a missing magnitude is -1."""
    return F.concat_ws(",", _time(F.col("ot_us")), *[F.col(c).cast("string") for c in ("lat", "lon", "dep")], F.coalesce(F.col("mag"), F.lit(-1.0)).cast("string"))


def catalog_lines(events: DataFrame) -> DataFrame:
    return events.select("event_id", catalog_line().alias("line"))


#: Line numbers kept for an event: a header and its picks.
PER_EVENT = 100_000


def phase_lines(events: DataFrame, phases: DataFrame, with_id: bool = False) -> DataFrame:
    """(line_no, line): each event's header, then its picks; with_id adds the event's id to the header.

    line_no orders the lines; it is made from a range sort, not by one task: event rank
    comes from its id, so lines of one event stand together.
    """
    head = F.concat_ws(",", catalog_line(), F.col("event_id").cast("string")) if with_id else catalog_line()
    row = F.concat_ws(",", "net_sta", _time(F.col("tp_us")), _time(F.col("ts_us")), F.coalesce(F.col("s_amp"), F.lit(-1.0)).cast("string"))
    own = events.select("event_id", F.lit(0).alias("part"), F.lit("").alias("sub"), head.alias("line")).unionByName(phases.select("event_id", F.lit(1).alias("part"), F.col("net_sta").alias("sub"), row.alias("line")))
    from pyspark.sql import Window

    within = F.row_number().over(Window.partitionBy("event_id").orderBy("part", "sub", "line"))
    return own.select((F.col("event_id") * PER_EVENT + within).alias("line_no"), "line")


def degrees_minutes(x: Column, positive: str, negative: str, width: int) -> Column:
    """K5: degrees and minutes with the hemisphere's letter, as location programs read them."""
    a = F.abs(x)
    deg = F.floor(a)
    return F.concat(F.format_string(f"%{width}d", deg), F.format_string(" %7.4f", (a - deg) * 60), F.when(x >= 0, positive).otherwise(negative))


def station_lines(stations: DataFrame) -> DataFrame:
    """K5: fixed-width stations; first row of each."""
    net, sta = F.split_part("net_sta", F.lit("."), F.lit(1)), F.split_part("net_sta", F.lit("."), F.lit(2))
    first = stations.dropDuplicates(["net_sta"])
    return first.select("net_sta", F.concat(F.rpad(sta, 6, " "), F.rpad(net, 4, " "), F.lit("BHZ  "), degrees_minutes(F.col("lat"), "N", "S", 2), F.lit(" "), degrees_minutes(F.col("lon"), "E", "W", 3), F.format_string("%4d", F.col("ele").cast("int"))).alias("line"))


def hundredths(us: Column, per: int) -> Column:
    return F.floor(us / per)


def solver_phase_lines(events: DataFrame, phases: DataFrame) -> DataFrame:
    """K6: (event_no, part, seq, line): header, picks and end line of each event for an absolute location run.

    Minutes of degrees are truncated to 1/100. S is given in 1/100 s from the minute of the
    pick's P (of S where there is no P), so it may pass 60 s. The event's magnitude is 0.
    """

    def place(x, n):
        a = F.abs(x)
        return F.concat(F.lpad(F.floor(a).cast("string"), n, " "), F.lpad(F.floor((a - F.floor(a)) * 6000 + 1e-6).cast("string"), 4, " "))

    t = lambda us: F.timestamp_micros(us)
    sec = lambda us, base: F.lpad(F.floor((us - base) / 10_000).cast("string"), 5, " ")
    minute = lambda us: F.floor(us / 60_000_000) * 60_000_000
    head = events.select("event_id", F.lit(0).alias("part"), F.lit("").alias("seq"), F.concat(F.date_format(t(F.col("ot_us")), "yyyyMMddHHmm"), F.lpad(F.floor(F.col("ot_us") % 60_000_000 / 10_000).cast("string"), 4, "0"), place(F.col("lat"), 2), F.when(F.col("lon") < 0, "W").otherwise("E"), place(F.col("lon"), 3), F.lpad(F.floor(F.col("dep") * 100).cast("string"), 5, " "), F.lit("  0")).alias("line"))
    base = minute(F.coalesce("tp_us", "ts_us"))
    net, sta = F.split_part("net_sta", F.lit("."), F.lit(1)), F.split_part("net_sta", F.lit("."), F.lit(2))
    p = F.when(F.col("tp_us").isNull(), "           ").otherwise(F.concat(F.lit("IP 0"), sec(F.col("tp_us"), base), F.lit("  ")))
    s_ = F.when(F.col("ts_us").isNull(), "          ").otherwise(F.concat(F.lit("ES 0"), sec(F.col("ts_us"), base), F.lit(" ")))
    row = phases.where("tp_us is not null or ts_us is not null").select("event_id", F.lit(1).alias("part"), F.col("net_sta").alias("seq"), F.concat(F.rpad(sta, 5, " "), F.rpad(net, 3, " "), F.lit(" BHZ "), F.date_format(t(base), "yyyyMMddHHmm"), p, s_).alias("line"))
    end = events.select("event_id", F.lit(2).alias("part"), F.lit("").alias("seq"), F.lpad(F.col("event_id").cast("string"), 72, " ").alias("line"))
    return head.unionByName(row).unionByName(end)


def travel_time_lines(events: DataFrame, phases: DataFrame, dep_corr: float = 0.0) -> DataFrame:
    """(event_id, part, line): `#` headers and `sta time weight phase` rows for catalog relocation."""
    t = F.timestamp_micros("ot_us")
    head = events.select("event_id", F.lit(0).alias("part"), F.concat(F.lit("# "), F.date_format(t, "yyyy MM dd HH mm ss"), F.format_string(".%02d %.4f %.4f %.2f %.2f 0.0 0.0 0.0 %d", F.floor(F.pmod("ot_us", F.lit(1_000_000)) / 10_000), "lat", "lon", F.col("dep") + dep_corr, F.coalesce("mag", F.lit(-1.0)), "event_id")).alias("line"))
    sta = F.split_part("net_sta", F.lit("."), F.lit(2))
    both = F.array(F.struct(F.lit("P").alias("ph"), F.col("tp_us").alias("t")), F.struct(F.lit("S").alias("ph"), F.col("ts_us").alias("t")))
    rows = phases.join(events.select("event_id", "ot_us").withColumnRenamed("ot_us", "o"), "event_id").select("event_id", sta.alias("sta"), "o", F.explode(both).alias("x")).where("x.t is not null")
    return head.unionByName(rows.select("event_id", F.lit(1).alias("part"), F.format_string("%-5s %9.4f 1.000 %s", "sta", (F.col("x.t") - F.col("o")) / 1e6, "x.ph").alias("line")))


def differential_time_lines(dt: DataFrame) -> DataFrame:
    """(evid1, evid2, part, line); weights are roots of the correlation."""
    head = dt.select("evid1", "evid2").distinct().select("evid1", "evid2", F.lit(0).alias("part"), F.format_string("# %d %d 0.0", "evid1", "evid2").alias("line"))
    rows = dt.select("evid1", "evid2", F.lit(1).alias("part"), F.format_string("%s %.5f %.4f %s", "sta", "dt", F.sqrt("cc"), "phase").alias("line"))
    return head.unionByName(rows)


def control_file(template: str, values: dict[str, str], prefix: bool = True) -> str:
    """A control file: lines that start with (or hold) a key give way to its value."""
    out = []
    for line in template.split("\n"):
        hit = next((v for k, v in values.items() if (line.startswith(k) if prefix else k in line)), None)
        out.append(line if hit is None else hit)
    return "\n".join(out)


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Part files whose names and lines follow the order."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_split(best: DataFrame, path: str) -> None:
    """Good and bad locations under path, in one pass by partition."""
    best.withColumn("kind", F.when(F.col("is_loc"), "good").otherwise("bad")).write.mode("overwrite").partitionBy("kind").parquet(path)
