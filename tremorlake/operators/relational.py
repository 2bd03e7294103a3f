"""Catalyst-only operators on picks, events, phases and samples.

Times are microseconds (long columns *_us), so every strict |a - b| < w is the integer
range a - (w - 1) .. a + (w - 1) and no float drift enters a comparison. Windows are
partitioned by day, or by channel and block of samples: no operator here puts all rows
into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import cos_degrees, distance_km, origin_time, safe_divide
from ..params import KM_PER_DEGREE, Association, Grid, Neural, Pairing

DAY_US = 86_400_000_000


# picks ---------------------------------------------------------------------------------
def with_origin_time(picks: DataFrame, vp: float, vs: float) -> DataFrame:
    """adds sta_ot_us."""
    return picks.withColumn("sta_ot_us", origin_time(F.col("tp_us"), F.col("ts_us"), vp, vs))


def known_stations(picks: DataFrame, stations: DataFrame) -> DataFrame:
    """picks at known stations."""
    return picks.join(stations.select("net_sta"), "net_sta", "left_semi")


def ordered_phases(picks: DataFrame) -> DataFrame:
    """S not before P."""
    return picks.where("tp_us <= ts_us")


def with_day(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("day", F.floor(F.col(column) / DAY_US).cast("long"))


def neighbour_counts(picks: DataFrame, ot_dev_us: int) -> DataFrame:
    """Picks of the same day with |ot - own ot| < ot_dev, itself included."""
    w = Window.partitionBy("day").orderBy("sta_ot_us").rangeBetween(-(ot_dev_us - 1), ot_dev_us - 1)
    return picks.withColumn("n_nbr", F.count("*").over(w))


def densest(counted: DataFrame) -> DataFrame:
    """Each day's earliest pick of the most neighbours, ties by station and P time (O1)."""
    first = F.struct((-F.col("n_nbr")).alias("k"), "sta_ot_us", "net_sta", "tp_us", "ts_us", "s_amp")
    return counted.groupBy("day").agg(F.min(first).alias("x")).select("day", "x.sta_ot_us", "x.net_sta", "x.tp_us", (-F.col("x.k")).alias("n_nbr"))


def cluster_origin(picks: DataFrame, centres: DataFrame, ot_dev_us: int) -> DataFrame:
    """The upper-median pick's origin time of the picks around each day's centre."""
    near = picks.join(centres.select("day", F.col("sta_ot_us").alias("centre")), "day").where(F.abs(F.col("sta_ot_us") - F.col("centre")) < ot_dev_us)
    members = near.groupBy("day").agg(F.sort_array(F.collect_list("sta_ot_us")).alias("ots"))
    return members.select("day", F.size("ots").cast("long").alias("n"), F.element_at("ots", F.expr("cast(size(ots) div 2 + 1 as int)")).alias("ot_us"))


def gaps_and_islands(samples: DataFrame, by: str = "chn") -> DataFrame:
    """Runs of consecutive idx, with their first, last, length and median."""
    w = Window.partitionBy(by).orderBy("idx")
    runs = samples.withColumn("run", F.col("idx") - F.row_number().over(w))
    return runs.groupBy(by, "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"), F.median("idx").alias("middle")).drop("run")


def merge_neighbours(picks: DataFrame, tp_dev_us: int, ts_dev_us: int) -> DataFrame:
    """Picks whose probability sum is the largest of those of the station with |dtp| < tp_dev and |dts| < ts_dev; ties stay.

    Buckets of tp_dev with one neighbour on each side make it an equi-join.
    """
    own = picks.withColumn("prob", F.col("p_prob") + F.col("s_prob")).withColumn("b", F.floor(F.col("tp_us") / tp_dev_us))
    other = own.select("net_sta", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), F.col("tp_us").alias("tp2"), F.col("ts_us").alias("ts2"), F.col("prob").alias("prob2"))
    beaten = own.alias("o").join(other.alias("n"), (F.col("o.net_sta") == F.col("n.net_sta")) & (F.col("o.b") == F.col("n.b")) & (F.abs(F.col("tp_us") - F.col("tp2")) < tp_dev_us) & (F.abs(F.col("ts_us") - F.col("ts2")) < ts_dev_us) & (F.col("prob2") > F.col("prob")), "left_anti")
    return beaten.drop("b", "prob")


def candidate_pairs(detections: DataFrame) -> DataFrame:
    """P and S detections (window_id, phase, idx, prob) of one window with s_idx > p_idx."""
    p = detections.where("phase = 'P'").select("window_id", F.col("idx").alias("p_idx"), F.col("prob").alias("p_prob"))
    s = detections.where("phase = 'S'").select("window_id", F.col("idx").alias("s_idx"), F.col("prob").alias("s_prob"))
    return p.join(s, "window_id").where("s_idx > p_idx")


def dead_time(times: DataFrame, gap_us: int, by: str = "chn", column: str = "t_us") -> DataFrame:
    """Greedy chain of each channel: the first time, then each first one more than gap after the last taken.

    A fold over the channel's sorted times; channels are as long as a station-day.
    """
    sorted_ = times.groupBy(by).agg(F.sort_array(F.collect_list(column)).alias("ts"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("kept"))
    take = lambda s, t: F.when(s["last"].isNull() | (t > s["last"] + gap_us), F.struct(t.alias("last"), F.concat(s["kept"], F.array(t)).alias("kept"))).otherwise(s)
    return sorted_.select(by, F.explode(F.aggregate("ts", start, take, lambda s: s["kept"])).alias(column))


# samples -------------------------------------------------------------------------------
#: Samples of a channel that one window partition has.
BLOCK = 1 << 16


def _blocks(samples: DataFrame, before: int, after: int, by: str = "chn") -> DataFrame:
    """samples (idx consecutive within a channel) with `block`; rows that windows of so many samples before or after need stand in the neighbour's block too (`own` is false there)."""
    home = lambda x: F.floor(x / BLOCK)
    blocks = F.sequence(home(F.col("idx") - after), home(F.col("idx") + before))
    return samples.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == home(F.col("idx")))


def _block_window(by: str = "chn"):
    return Window.partitionBy(by, "block").orderBy("idx")


def _own(df: DataFrame, *drop: str) -> DataFrame:
    return df.where("own").drop("own", "block", *drop)


def sta_lta(samples: DataFrame, ns: int, nl: int) -> DataFrame:
    """Leading short over trailing long mean of v of (chn, idx); 0 in the first nl samples and where it is no number."""
    w = _block_window()
    size = samples.groupBy("chn").agg(F.count("*").alias("size"), F.min("idx").alias("idx0"))  # one row a channel
    sums = _blocks(samples, nl, ns).withColumn("short", F.sum("v").over(w.rowsBetween(1, ns))).withColumn("long", F.sum("v").over(w.rowsBetween(-nl + 1, 0)))
    placed = _own(sums).join(size, "chn").withColumn("place", F.col("idx") - F.col("idx0"))
    sta = F.when(F.col("place") < F.col("size") - ns, F.col("short") / ns).otherwise(F.lit(0.0))
    cf = F.when((F.col("place") < nl) | (F.col("size") < nl + ns), 0.0).otherwise(safe_divide(sta, F.col("long") / nl))
    return placed.withColumn("cf", cf).drop("short", "long", "size", "idx0", "place")


def rolling_kurtosis(samples: DataFrame, n: int) -> DataFrame:
    """Excess kurtosis (population) of v over idx .. idx + n - 1, for full windows."""
    w = _block_window().rowsBetween(0, n - 1)
    return _own(_blocks(samples, 0, n).withColumn("kurt", F.kurtosis("v").over(w)).withColumn("m", F.count("*").over(w)).where(F.col("m") == n), "m")


def first_difference(samples: DataFrame) -> DataFrame:
    """W11."""
    return _own(_blocks(samples, 1, 0).withColumn("diff", F.col("v") - F.lag("v").over(_block_window())))


def energy_norm(samples: DataFrame, n: int) -> DataFrame:
    """Sqrt of the energy of the n samples after each."""
    w = _block_window().rowsBetween(1, n)
    return _own(_blocks(samples, 0, n).withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(w))).withColumn("m", F.count("*").over(w)).where(F.col("m") == n), "m")


# stations and traces -------------------------------------------------------------------
def gain_at(traces: DataFrame, gains: DataFrame) -> DataFrame:
    """The first interval (by ord) with t0 < mid < t1, else the station's last one; an interval without ends always holds."""
    both = traces.join(gains, "net_sta")
    inside = F.col("t0_us").isNull() | ((F.col("t0_us") < F.col("mid_us")) & (F.col("mid_us") < F.col("t1_us")))
    key = F.struct(F.when(inside, 0).otherwise(1).alias("a"), F.when(inside, F.col("ord")).otherwise(-F.col("ord")).alias("b"))
    first = both.groupBy("trace_id", "net_sta").agg(F.min_by(F.struct("ord", "gain"), key).alias("g"))
    return first.select("trace_id", "net_sta", "g.ord", "g.gain")


def _on_grid(rows: DataFrame, stations: DataFrame, p: Association) -> DataFrame:
    """rows (with a station's lat, lon, ele) at each cell of the grid around all stations, with its place (zi, xi, yi, lon_c, lat_c, dep) and ttp.

    The grid's bounds are one row; each row makes its own cells, in the partition where it stands, so nothing that grows is sent around.
    """
    spark = rows.sparkSession
    box = stations.agg(*[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))])
    side = lambda c: (F.col(f"{c}_hi") - F.col(f"{c}_lo")) * p.xy_margin
    grid = box.select((F.col("lon_lo") - side("lon")).alias("lon0"), (F.col("lat_lo") - side("lat")).alias("lat0"), *[F.floor((F.col(f"{c}_hi") + side(c) - (F.col(f"{c}_lo") - side(c))) / p.xy_grid).cast("int").alias(n) for c, n in (("lon", "nx"), ("lat", "ny"))])
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few rows, many cells
    dz = lambda z: F.lit(float(z)) + F.col("ele") / 1000
    depths = F.array(*[F.struct(F.lit(i).alias("zi"), F.lit(float(z)).alias("dep"), (dz(z) * dz(z)).alias("dz2")) for i, z in enumerate(p.z_grids)])
    # what the cells of a depth or of a column share is worked out once for each
    at = dealt.join(F.broadcast(grid.where("nx > 0 and ny > 0"))).withColumn("cos_lat", cos_degrees(F.col("lat"))).withColumn("z", F.explode(depths))
    at = at.select(*rows.columns, "nx", "ny", "lon0", "lat0", "cos_lat", "z.*").withColumn("xi", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("lon_c", F.col("lon0") + F.col("xi") * p.xy_grid)
    dx = KM_PER_DEGREE * (F.col("lon_c") - F.col("lon")) * F.col("cos_lat")
    at = at.withColumn("dx2", dx * dx).withColumn("yi", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("lat_c", F.col("lat0") + F.col("yi") * p.xy_grid)
    dy = KM_PER_DEGREE * (F.col("lat_c") - F.col("lat"))
    return at.select(*rows.columns, "zi", "xi", "yi", (F.sqrt(F.col("dx2") + dy * dy + F.col("dz2")) / p.vp).alias("ttp"), "lon_c", "lat_c", "dep")


def travel_times(stations: DataFrame, p: Association) -> DataFrame:
    """(net_sta, zi, xi, yi, ttp) on the grid around all stations, straight rays."""
    return _on_grid(stations.select("net_sta", "lat", "lon", "ele"), stations, p).select("net_sta", "zi", "xi", "yi", "ttp", "lon_c", "lat_c", "dep")


def cell_scan(cluster: DataFrame, stations: DataFrame, p: Association, max_res: float) -> DataFrame:
    """Each cluster's cell with most picks within max_res, then least summed residual, then first (z, x, y).

    Travel times are made for the clusters' picks alone, and are added up where they are made.
    """
    picks = cluster.select("cluster_id", "ot_us", "net_sta", "tp_us").join(stations.select("net_sta", "lat", "lon", "ele"), "net_sta")
    res = F.abs(F.col("ttp") - (F.col("tp_us") - F.col("ot_us")) / 1e6)
    hit = _on_grid(picks, stations, p).withColumn("res", res).where(F.col("res") < max_res)
    cells = hit.groupBy("cluster_id", "zi", "xi", "yi").agg(F.count("*").alias("num_sta"), F.sum("res").alias("res"))
    best = F.min(F.struct((-F.col("num_sta")).alias("k"), F.round("res", 9).alias("r"), "zi", "xi", "yi"))
    return cells.groupBy("cluster_id").agg(best.alias("b")).select("cluster_id", (-F.col("b.k")).alias("num_sta"), F.round(F.col("b.r") / -F.col("b.k"), 6).alias("res"), "b.zi", "b.xi", "b.yi")


# magnitudes ----------------------------------------------------------------------------
def station_magnitudes(phases: DataFrame, events: DataFrame, stations: DataFrame) -> DataFrame:
    """A3, first part: log10 of amplitude (micrometres) and hypocentral distance (km), plus 1."""
    j = phases.select("event_id", "net_sta", "seq", "s_amp").join(events.select("event_id", F.col("lat").alias("elat"), F.col("lon").alias("elon"), "dep"), "event_id").join(stations, "net_sta")
    dy = KM_PER_DEGREE * (F.col("lat") - F.col("elat"))
    dx = KM_PER_DEGREE * (F.col("lon") - F.col("elon")) * cos_degrees(F.col("lat"))
    dz = F.col("dep") + F.col("ele") / 1000
    return j.select("event_id", "net_sta", "seq", (F.log10(F.col("s_amp") * 1e6) + F.log10(F.sqrt(dx * dx + dy * dy + dz * dz)) + 1).alias("mag"))


def event_magnitudes(station_mags: DataFrame) -> DataFrame:
    """A3, second part: the median without the one value farthest from the median (the first in seq on ties)."""
    middle = station_mags.groupBy("event_id").agg(F.median("mag").alias("mid"))
    dev = station_mags.join(middle, "event_id").withColumn("dev", F.round(F.abs(F.col("mag") - F.col("mid")), 9))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("dev"), "seq", "net_sta", "mag"))
    return dev.withColumn("rk", rank).where("rk > 1").groupBy("event_id").agg(F.median("mag").alias("mag"), F.count("*").alias("n_used"))


# locations and cells -------------------------------------------------------------------
def best_location(candidates: DataFrame) -> DataFrame:
    """Per evid a reliable candidate first, then quality, azimuth gap, most phases, rms."""
    w = Window.partitionBy("evid").orderBy(F.desc("is_loc"), "qua", "azm", F.desc("npha"), "rms", "cand")
    return candidates.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def grid_cells(g: Grid, pad: bool) -> list[tuple[int, int, float, float, float, float]]:
    """(i, j, lat_lo, lat_hi, lon_lo, lon_hi) of each cell, widened by the pad where asked."""
    out = []
    for i in range(g.num[0]):
        for j in range(g.num[1]):
            dlon, dlat = (g.lon[1] - g.lon[0]) / g.num[0], (g.lat[1] - g.lat[0]) / g.num[1]
            px, py = g.pad if pad else (0.0, 0.0)
            out.append((i, j, g.lat[0] + j * dlat - py, g.lat[0] + (j + 1) * dlat + py, g.lon[0] + i * dlon - px, g.lon[0] + (i + 1) * dlon + px))
    return out


def assign_cells(events: DataFrame, g: Grid, pad: bool) -> DataFrame:
    """(event_id, i, j) of each cell (low, high] that holds an event; padded cells overlap. The cells are settings, so they are literals."""
    cells = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(c, ("i", "j", "a", "b", "c", "d"), strict=True)]) for c in grid_cells(g, pad)])
    inside = F.filter(cells, lambda c: (F.col("lat") > c["a"]) & (F.col("lat") <= c["b"]) & (F.col("lon") > c["c"]) & (F.col("lon") <= c["d"]))
    return events.select("event_id", F.explode(inside).alias("c")).select("event_id", "c.i", "c.j")


def owned(relocated: DataFrame, owners: DataFrame) -> DataFrame:
    """Relocated rows (event_id, i, j, ...) whose cell owns the event."""
    return relocated.join(owners.select("event_id", "i", "j"), ["event_id", "i", "j"], "left_semi")


# pairs ---------------------------------------------------------------------------------
#: The cell itself, and of each two opposite neighbours one.
HALF = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]


def event_pairs(events: DataFrame, p: Pairing) -> DataFrame:
    """Unordered pairs of distinct events (event_id is unique) within the box |dlat|, |dlon| cos(lat), |ddep| (strict) of either one.

    Cells as large as the box make it an equi-join; each event also stands in the half of
    the cells around, so that of two neighbouring cells one meets the other once.
    """
    dlat, dlon, ddep = p.loc_dev
    lo = events.agg(F.max(F.abs("lat")).alias("m"))
    east = lo.select((F.lit(dlon / KM_PER_DEGREE) / F.greatest(cos_degrees(F.col("m")), F.lit(0.01))).alias("w"))
    e = events.join(F.broadcast(east)).select("event_id", "lat", "lon", "dep", F.floor(F.col("lat") / (dlat / KM_PER_DEGREE)).alias("bi"), F.floor(F.col("lon") / F.col("w")).alias("bj"), F.floor(F.col("dep") / ddep).alias("bk"))
    cells = F.array(*[F.struct((F.col("bi") + a).alias("bi"), (F.col("bj") + b).alias("bj"), (F.col("bk") + c).alias("bk"), F.lit((a, b, c) == (0, 0, 0)).alias("same")) for a, b, c in HALF])
    n = e.select(F.col("event_id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("dep").alias("dep2"), F.explode(cells).alias("c")).select("id2", "lat2", "lon2", "dep2", "c.*")
    near = (KM_PER_DEGREE * F.abs(F.col("lat") - F.col("lat2")) < dlat) & (KM_PER_DEGREE * F.abs(F.col("lon") - F.col("lon2")) * F.least(cos_degrees(F.col("lat")), cos_degrees(F.col("lat2"))) < dlon) & (F.abs(F.col("dep") - F.col("dep2")) < ddep)
    once = ~F.col("same") | (F.col("event_id") < F.col("id2"))
    return e.join(n, ["bi", "bj", "bk"]).where(near & once).select(F.least("event_id", "id2").alias("evid1"), F.greatest("event_id", "id2").alias("evid2"))


def shared_stations(pairs: DataFrame, phases: DataFrame, least: int) -> DataFrame:
    """Pairs with so many stations in common, and their number."""
    own = phases.groupBy("event_id").agg(F.collect_set("net_sta").alias("s"))
    a, b = own.select(F.col("event_id").alias("evid1"), F.col("s").alias("s1")), own.select(F.col("event_id").alias("evid2"), F.col("s").alias("s2"))
    return pairs.join(a, "evid1").join(b, "evid2").select("evid1", "evid2", F.size(F.array_intersect("s1", "s2")).cast("long").alias("n_sta")).where(F.col("n_sta") >= least)


def nearest(pairs: DataFrame, events: DataFrame, k: int) -> DataFrame:
    """O3: each event's k nearest partners by squared distance; ties at the cut stay."""
    both = pairs.select("evid1", "evid2").union(pairs.select("evid2", "evid1"))
    side = lambda n: events.select(F.col("event_id").alias(f"evid{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("lat", "lon", "dep")])
    d = both.join(side(1), "evid1").join(side(2), "evid2")
    dist = distance_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), F.col("lat1"))
    d = d.withColumn("dist", F.round(F.sqrt(dist * dist + F.pow(F.col("dep1") - F.col("dep2"), F.lit(2.0))), 6))
    return d.withColumn("rk", F.rank().over(Window.partitionBy("evid1").orderBy("dist"))).where(F.col("rk") <= k).select("evid1", "evid2", "dist", F.col("rk").cast("long").alias("rk"))


def earliest_picks(phases: DataFrame, k: int) -> DataFrame:
    """O2: an event's k earliest P picks."""
    w = Window.partitionBy("event_id").orderBy("tp_us", "net_sta", "seq")
    return phases.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).drop("rk")


def select_dt(dt: DataFrame, events: DataFrame, stations: DataFrame, p: Pairing) -> DataFrame:
    """Differential times between known events close to each other and to the station, with good correlation and small dt."""
    side = lambda n: events.select(F.col("event_id").alias(f"evid{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("lat", "lon", "dep")])
    j = dt.join(side(1), "evid1").join(side(2), "evid2").join(stations.select(F.col("net_sta").alias("sta"), "lat", "lon"), "sta")
    apart = distance_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), (F.col("lat1") + F.col("lat2")) / 2)
    epi = F.least(*[distance_km(F.col(f"lat{n}"), F.col(f"lon{n}"), F.col("lat"), F.col("lon"), (F.col(f"lat{n}") + F.col("lat")) / 2) for n in (1, 2)])
    limit = F.when(F.col("phase") == "P", p.dt_thres[0]).otherwise(p.dt_thres[1])
    good = (apart < p.pair_max) & (F.abs(F.col("dep1") - F.col("dep2")) < p.dep_dev) & (epi <= p.epi_max) & (F.col("weight") * F.col("weight") >= p.cc_thres) & (F.abs("dt") <= limit)
    return j.where(good).select("evid1", "evid2", "sta", "phase", "dt", "weight")


def pairs_with_stations(dt: DataFrame, least: int) -> DataFrame:
    """Pairs with so many distinct stations."""
    return dt.groupBy("evid1", "evid2").agg(F.countDistinct("sta").alias("n_sta")).where(F.col("n_sta") >= least)


def catalog_dt(pairs: DataFrame, phases: DataFrame, min_links: int, max_obs: int) -> DataFrame:
    """Catalog differential times of pairs: travel times of phases at shared stations, min_links of them or none, the max_obs earliest."""
    long = phases.select("event_id", F.col("net_sta").alias("sta"), F.explode(F.array(F.struct(F.lit("P").alias("phase"), (F.col("tp_us") - F.col("ot_us")).alias("tt")), F.struct(F.lit("S").alias("phase"), (F.col("ts_us") - F.col("ot_us")).alias("tt")))).alias("x")).select("event_id", "sta", "x.phase", "x.tt").where("tt is not null").groupBy("event_id", "sta", "phase").agg(F.min("tt").alias("tt"))
    a = long.select(F.col("event_id").alias("evid1"), "sta", "phase", F.col("tt").alias("tt1"))
    b = long.select(F.col("event_id").alias("evid2"), "sta", "phase", F.col("tt").alias("tt2"))
    obs = pairs.select("evid1", "evid2").join(a, "evid1").join(b, ["evid2", "sta", "phase"])
    w = Window.partitionBy("evid1", "evid2")
    ranked = obs.withColumn("links", F.count("*").over(w)).withColumn("rk", F.row_number().over(w.orderBy("tt1", "sta", "phase")))
    return ranked.where((F.col("links") >= min_links) & (F.col("rk") <= max_obs)).select("evid1", "evid2", "sta", "phase", "tt1", "tt2")


# training data -------------------------------------------------------------------------
def association_flags(picks: DataFrame, phases: DataFrame, by_station: bool = False) -> DataFrame:
    """Marks picks whose day and P time (and, where asked, station) an event has."""
    key = ["day", "tp_us", *(["net_sta"] if by_station else [])]
    marks = phases.select(*key).distinct().withColumn("hit", F.lit(True))
    return picks.join(marks, key, "left").withColumn("is_assoc", F.coalesce("hit", F.lit(False))).drop("hit")


def station_day_counts(flagged: DataFrame) -> DataFrame:
    """Unassociated and associated picks per station and day."""
    return flagged.groupBy("net_sta", "day").agg(F.count_if(~F.col("is_assoc")).alias("n_un"), F.count_if("is_assoc").alias("n_as"))


def negative_quota(counts: DataFrame, num_aug: float, max_ratio: float) -> DataFrame:
    """Negative windows to cut for each station and day; 0 from an associated share of max_ratio on."""
    total = counts.agg(F.sum("n_as").alias("pos"), F.sum(F.col("n_un") + F.col("n_as")).alias("all"))
    ratio = total.select((num_aug * F.col("pos") / (F.col("all") - F.col("pos"))).alias("ratio"))
    share = F.col("n_as") / (F.col("n_un") + F.col("n_as"))
    quota = F.when(share >= max_ratio, 0).otherwise(F.floor(F.col("n_un") * F.col("ratio") * (max_ratio - share) / max_ratio + 1e-9)).cast("long")
    return counts.join(F.broadcast(ratio)).select("net_sta", "day", "n_un", "n_as", quota.alias("quota"))


def noise_windows(windows: DataFrame, picks: DataFrame) -> DataFrame:
    """windows (net_sta, t0_us, t1_us) of their station that hold no pick's P and S both (open interval)."""
    cond = (F.col("w.net_sta") == F.col("p.net_sta")) & (F.col("p.tp_us") > F.col("w.t0_us")) & (F.col("p.ts_us") < F.col("w.t1_us")) & (F.col("p.tp_us") < F.col("w.t1_us")) & (F.col("p.ts_us") > F.col("w.t0_us"))
    return windows.alias("w").join(picks.alias("p"), cond, "left_anti")


def step_labels(picks: DataFrame, p: Neural) -> DataFrame:
    """Labels of the steps of a window (0 none, 1 P, 2 S) from picks (sample_id, tp, ts: seconds from its start).

    A phase has the steps that hold its time. S takes over from P, and where the S block
    would begin no later than the P block, it begins in the middle of that.
    """
    whole = lambda x: F.round(x / p.step_stride, 6).cast("int")
    at = picks.select(
        "sample_id",
        F.when(F.col("tp") < p.step_len, 0).otherwise(whole(F.col("tp") - p.step_len) + 1).alias("p0"),
        (whole(F.col("tp")) + 1).alias("p1"),
        (whole(F.col("ts") - p.step_len) + 1).alias("s1"),
        (whole(F.col("ts")) + 1).alias("s2"),
    )
    at = at.withColumn("s0", F.when(F.col("s1") <= F.col("p0"), F.col("p0") + F.floor((F.col("p1") - F.col("p0")) / 2)).otherwise(F.col("s1")))
    label = F.transform(F.sequence(F.lit(0), F.lit(p.steps - 1)), lambda i: F.when((i >= F.col("s0")) & (i < F.col("s2")), 2).when((i >= F.col("p0")) & (i < F.col("p1")), 1).otherwise(0))
    return at.select("sample_id", label.alias("target"))


def unfold(traces: DataFrame, length: int, stride: int) -> DataFrame:
    """(trace_id, step, seq): slices of data of so many samples, a stride apart."""
    n = F.floor((F.size("data") - length) / stride).cast("int")
    steps = F.when(F.size("data") >= length, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return traces.select("trace_id", F.explode(F.transform(steps, lambda i: F.struct(i.alias("step"), F.slice("data", i * stride + 1, length).alias("seq")))).alias("x")).select("trace_id", "x.step", "x.seq")


# arrays --------------------------------------------------------------------------------
def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _given(value: Column, use) -> Column:
    """use(value), the value being worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def demeaned(a: Column) -> Column:
    """Less its mean."""
    return _given(total(a) / F.size(a), lambda mean: F.transform(a, lambda x: x - mean))


def peak_to_peak(a: Column) -> Column:
    """A11."""
    return F.array_max(a) - F.array_min(a)


def max_normalised(a: Column) -> Column:
    """Over its largest absolute value; all zero stays."""
    return _given(F.array_max(F.transform(a, F.abs)), lambda top: F.transform(a, lambda x: safe_divide(x, top)))


def correlation_max(x: Column, y: Column, n: int, m: int, skip_first: bool) -> tuple[Column, Column]:
    """The largest normalised `valid` correlation of x (n samples) with y (m < n), and its lag; skip_first leaves out lag 0 as the compatibility mode does."""
    lags = F.sequence(F.lit(1 if skip_first else 0), F.lit(n - m))
    norm_y = F.sqrt(total(F.transform(y, lambda v: v * v)))
    # rounded, so that equal peaks tie alike on any engine
    one = lambda k: F.round(safe_divide(total(F.zip_with(F.slice(x, k + 1, m), y, lambda a, b: a * b)), F.sqrt(total(F.transform(F.slice(x, k + 1, m), lambda v: v * v))) * norm_y), 9)
    cc = F.transform(lags, one)
    return F.array_max(cc), (F.array_position(cc, F.array_max(cc)) - 1).cast("long")
