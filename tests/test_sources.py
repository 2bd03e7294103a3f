import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.sources import location, phases, picks, stations, traces, writers

T0 = 1_562_198_400_000_000  # 2019-07-04


def lines(spark, *text):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no long, line string")


def test_station_layouts(spark, tmp_path):
    f = tmp_path / "a.sta"
    f.write_text("N.A,35.5,-117.5,1000,2e8\nN.B,36,-118,10,1,2,3\nN.C,36,-118,10,1,2,3,2019/01/01,2019/06/01\nN.C,36,-118,10,4,5,6,2019/06/01,2020/01/01\nN.D,1,2\nN.E,36.1,-118,5,7")
    st, g = stations.read_stations(spark, str(f))
    assert sorted(r["net_sta"] for r in st.collect()) == ["N.A", "N.B", "N.C", "N.E"]
    got = {(r["net_sta"], r["ord"]): (r["ge"], r["gn"], r["gz"], r["t0_us"] is None) for r in g.collect()}
    assert got == {("N.A", 1): (2e8, 2e8, 2e8, True), ("N.B", 1): (1, 2, 3, True), ("N.C", 1): (1, 2, 3, False), ("N.C", 2): (4, 5, 6, False), ("N.E", 1): (7, 7, 7, True)}
    assert {r["name"] for r in stations.with_bare_names(st).collect()} == {"N.A", "N.B", "N.C", "N.E", "A", "B", "C", "E"}


def test_phase_files(spark):
    df = lines(spark, "2019-07-04T00:00:10.500000Z,35.5,-117.5,8.0,2.1,77", "N.A,2019-07-04T00:00:12.000000Z,-1,1e-5", "N.A,2019-07-04T00:00:13.000000Z,2019-07-04T00:00:15.000000Z,2e-5", "NET.STATION1,-1,2019-07-04T00:00:16Z,-1", "5_20190704000020.00,2019-07-04T00:00:20Z,35,-117,5,1.0", "N.B,2019-07-04T00:00:21Z,2019-07-04T00:00:22Z,1e-6")
    ev, ph = phases.split_phase_lines(df)
    e = {r["event_no"]: r for r in ev.collect()}
    assert (e[1]["evid"], e[1]["num_pos"], e[1]["mag"], e[1]["ot_us"]) == ("77", 3, 2.1, T0 + 10_500_000)
    assert (e[2]["evid"], e[2]["event_name"], e[2]["lat"]) == ("5", "20190704000020.00", 35.0)
    p = {(r["event_no"], r["net_sta"]): r for r in ph.collect()}
    assert p[(1, "N.A")]["tp_us"] == T0 + 13_000_000 and p[(1, "NET.STATION1")]["tp_us"] is None and len(p) == 3
    # the length rule misreads a long station name
    assert phases.split_phase_lines(df, rule=10)[0].count() == 3
    assert phases.between(ev, T0 + 10_500_000, T0 + 30_000_000).count() == 1
    assert phases.between(ev, T0 + 10_500_000, T0 + 30_000_000, True).count() == 2


def test_round_trip_of_phase_files(spark, tmp_path):
    ev = spark.createDataFrame([(1, T0, 35.5, -117.5, 8.0, 2.1), (2, T0 + 5_000_000, 35.0, -117.0, 5.0, None)], "event_id long, ot_us long, lat double, lon double, dep double, mag double")
    ph = spark.createDataFrame([(1, "N.A", T0 + 1_000_000, None, 1e-5), (2, "N.B", T0 + 6_000_000, T0 + 7_000_000, None), (1, "N.C", T0 + 2_000_000, T0 + 3_000_000, 2e-6)], "event_id long, net_sta string, tp_us long, ts_us long, s_amp double")
    out = str(tmp_path / "pha")
    writers.write_lines(writers.phase_lines(ev, ph, with_id=True).coalesce(1), out, "line_no")
    e2, p2 = phases.read_phases(spark, out + "/part-*")
    assert sorted((r["evid"], r["ot_us"], r["mag"]) for r in e2.collect()) == [("1", T0, 2.1), ("2", T0 + 5_000_000, -1.0)]
    assert sorted((r["net_sta"], r["tp_us"], r["ts_us"]) for r in p2.select("net_sta", "tp_us", F.coalesce("ts_us", F.lit(0)).alias("ts_us")).collect()) == [("N.A", T0 + 1_000_000, 0), ("N.B", T0 + 6_000_000, T0 + 7_000_000), ("N.C", T0 + 2_000_000, T0 + 3_000_000)]


def test_pick_files(spark, tmp_path):
    p = spark.createDataFrame([("N.A", T0, T0 + 1_000_000, T0 + 2_000_000, 1.5e-6, 12.34, 3.0, 2.0, 1.0, 0.55, 0.912, 0.5)], "net_sta string, sta_ot_us long, tp_us long, ts_us long, s_amp double, p_snr double, fd double, amp_ratio double, a12 double, a13 double, p_prob double, s_prob double")
    a, b = tmp_path / "2019-07-04.pick", tmp_path / "n.pick"
    a.write_text(writers.pick_lines(p).collect()[0][0] + "\n")
    b.write_text(writers.neural_pick_lines(p).collect()[0][0] + "\n")
    r = picks.read_picks(spark, str(a)).collect()[0]
    assert (r["sta_ot_us"], r["tp_us"], r["ts_us"], r["p_snr"]) == (T0, T0 + 1_000_000, T0 + 2_000_000, 12.3)
    r = picks.read_neural_picks(spark, str(b)).collect()[0]
    assert r["p_prob"] == 0.91 and r["sta_ot_us"] < r["tp_us"]
    assert picks.read_picks(spark, str(tmp_path / "none.pick")).count() == 0


@pytest.mark.skipif("LOCATION_SUMMARY" not in os.environ, reason="LOCATION_SUMMARY and LOCATION_CATALOG name example outputs of a location run")
def test_summary_goldens(spark):
    got = location.read_summary(spark, os.environ["LOCATION_SUMMARY"], ground=1.5)
    rows = {r["evid"]: r for r in got.collect()}
    assert len(rows) == 2935 and sum(not r["is_loc"] for r in rows.values()) == 101
    with open(os.environ["LOCATION_CATALOG"]) as f:
        want = [x.split(",") for x in f.read().split()]
    for r, w in zip((rows[i] for i in sorted(rows)), want, strict=True):
        assert (f"{r['lat']:.4f}", f"{r['lon']:.4f}", f"{r['dep']:.1f}") == (w[1], w[2], w[3])
    assert {q: sum(r["qua"] == q for r in rows.values()) for q in "ABCD"} == {"A": 16, "B": 1387, "C": 1356, "D": 176}


def test_relocations_and_times(spark, tmp_path):
    row = "{} 35.1 -117.2 {} 0 0 0 0 0 0 2019 7 4 0 1 {}"
    df = spark.createDataFrame([(row.format(1, 5.5, "60.000"),), (row.format(2, "*****", "1.0"),), (row.format(3, 1.0, "x"),)], "line string")
    got = location.parse_relocations(df).collect()
    assert [(r["evid"], r["ot_us"]) for r in got] == [(1, T0 + 60_000_000 + 59_999_000)]
    f = tmp_path / "dt.cc"
    f.write_text("# 1 2 0.0\nA 0.01 0.9 P\nB -0.5 0.8 S\n# 3 4 0.0\nA 0.0 1.0 P\n")
    assert sorted(map(tuple, phases.read_differential_times(spark, str(f)).collect())) == [(1, 2, "A", "P", 0.01, 0.9), (1, 2, "B", "S", -0.5, 0.8), (3, 4, "A", "P", 0.0, 1.0)]
    assert location.latest_checkpoint(["a/2_1.ckpt", "a/10_x.ckpt", "a/10_b.ckpt", "a/z.ckpt"]) == "a/10_b.ckpt"
    assert location.latest_checkpoint(["a/2_1.ckpt"], 3) is None
    v = tmp_path / "v.cre"
    v.write_text("title\n5.5 0.0\n6.0 5.5\n")
    assert sorted(map(tuple, location.read_velocity_model(spark, str(v)).collect())) == [(0.0, 5.5), (5.5, 6.0)]


def test_traces(spark, tmp_path):
    day = tmp_path / "20190704"
    day.mkdir()
    x = np.arange(2000, dtype="f4")
    for sta, n in (("A", 3), ("B", 2)):
        for c in range(n):
            (day / f"N.{sta}.{c}.SAC").write_bytes(traces.encode_sac(T0, 100.0, x + c))
    (day / "N.C.0.SAC").write_bytes(b"junk")
    listed = {r["net_sta"]: r["paths"] for r in traces.list_day(spark, str(day)).collect()}
    assert set(listed) == {"N.A"} and len(listed["N.A"]) == 3
    single = {r["net_sta"]: r["paths"] for r in traces.list_day(spark, str(day), single=True).collect()}
    assert set(single) == {"N.A", "N.B", "N.C"} and len(set(single["N.B"])) == 1
    got = traces.read_traces(spark, str(day))
    r = got.where("net_sta = 'N.A' and chn = 2").collect()[0]
    assert (r["start_us"], r["rate"], r["npts"]) == (T0, 100.0, 2000) and r["data"][:2] == [2.0, 3.0]
    assert got.where("data is null").count() == 1
    gains = spark.createDataFrame([("N.A", 1, 2.0, 2.0, 4.0, None, None)], "net_sta string, ord int, ge double, gn double, gz double, t0_us long, t1_us long")
    assert traces.with_gain(got, gains).where("chn = 2").collect()[0]["data"][1] == 0.75
    chunks = traces.chunked(got.where("data is not null"), 4)
    w = spark.createDataFrame([(1, "N.A", T0 + 3_000_000, T0 + 9_000_000), (2, "N.A", T0 + 19_000_000, T0 + 21_000_000)], "window_id long, net_sta string, t0_us long, t1_us long")
    cut = {(r["window_id"], r["chn"]): r for r in traces.cut_windows(chunks, w, 4).collect()}
    assert set(cut) == {(1, 0), (1, 1), (1, 2)} and cut[(1, 0)]["data"] == list(x[300:900]) and cut[(1, 0)]["start_us"] == T0 + 3_000_000


def test_solver_text(spark):
    st = spark.createDataFrame([("CI.CLC", 35.5, -117.25, 775.0), ("CI.CLC", 1.0, 1.0, 0.0)], "net_sta string, lat double, lon double, ele double").limit(1)
    line = writers.station_lines(st).collect()[0]["line"]
    assert "35 30.0000N" in line and "117 15.0000W" in line
    ev = spark.createDataFrame([(9, T0 + 59_500_000, 35.5, -117.25, 8.0, 2.0)], "event_id long, ot_us long, lat double, lon double, dep double, mag double")
    ph = spark.createDataFrame([(9, "CI.CLC", T0 + 59_900_000, T0 + 61_000_000)], "event_id long, net_sta string, tp_us long, ts_us long")
    got = {r["part"]: r["line"] for r in writers.solver_phase_lines(ev, ph).collect()}
    assert got[0].startswith("2019070400005950") and " 5990" in got[1] and " 6100" in got[1] and got[2].strip() == "9"
    rows = [r["line"] for r in writers.travel_time_lines(ev, ph).orderBy("part").collect()]
    assert rows[0].startswith("# 2019 07 04 00 00 59.50 35.5000 -117.2500") and any("0.4000 1.000 P" in x for x in rows)
    assert writers.control_file("ZTR 5\nRMS 1\nX", {"ZTR": "ZTR 9"}) == "ZTR 9\nRMS 1\nX"
    dt = spark.createDataFrame([(1, 2, "A", "P", 0.012345, 0.81)], "evid1 long, evid2 long, sta string, phase string, dt double, cc double")
    assert sorted(r["line"] for r in writers.differential_time_lines(dt).collect())[0] == "# 1 2 0.0"
