import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import signal as G
from tremorlake.operators import location, neural
from tremorlake.operators import relational as R
from tremorlake.params import Association, Neural
from tremorlake.streaming import detect

Q = Neural()


def test_steps_and_labels(spark):
    assert Q.steps == 196
    x = neural.step_features(np.arange(3 * 2000.0).reshape(3, 2000), Q)
    assert x.shape == (196, 150) and x[2, 0] == 20 and x[2, 50] == 2020
    df = spark.createDataFrame([(1, 0.2, 3.04), (2, 5.0, 5.3), (3, 5.0, 5.0)], "sample_id long, tp double, ts double")
    got = {r["sample_id"]: np.array(r["target"]) for r in R.step_labels(df, Q).collect()}
    assert np.flatnonzero(got[1] == 1).tolist() == [0, 1, 2] and np.flatnonzero(got[1] == 2).tolist() == list(range(26, 31))
    assert np.flatnonzero(got[2] == 2)[0] == 48 + 1 and got[3].tolist().count(2) == 3


def gru_by_hand(x, w):
    w_ih, w_hh, b_ih, b_hh = w
    h, out, n = np.zeros(w_hh.shape[1]), [], w_hh.shape[1]
    s = lambda v: 1 / (1 + np.exp(-v))
    for v in x:
        a, b = w_ih @ v + b_ih, w_hh @ h + b_hh
        r, z = s(a[:n] + b[:n]), s(a[n : 2 * n] + b[n : 2 * n])
        h = (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :]) + z * h
        out.append(h)
    return np.array(out)


def test_inference():
    w = neural.Weights.random(features=5, hidden=4, heads=0, seed=1)
    x = np.random.default_rng(0).normal(size=(2, 7, 5))
    y = x[1]
    for f, b in w.gru:
        y = np.concatenate([gru_by_hand(y, f), gru_by_hand(y[::-1], b)[::-1]], axis=1)
    assert np.allclose(neural.infer(x, w)[1], y @ w.linear[0].T + w.linear[1])
    assert neural.infer(x, neural.Weights.random(features=5, hidden=4, heads=4)).shape == (2, 7, 3)


def test_decode():
    prob = np.zeros((196, 3))
    prob[10:13, 1], prob[40:44, 2], prob[5, 2] = [0.6, 0.9, 0.7], 0.8, 0.9
    assert neural.decode(prob, Q) == [(pytest.approx(0.25 + 1.1), pytest.approx(0.25 + 4.15), 0.9, 0.8)]
    assert neural.decode(np.zeros((196, 3)), Q) == []
    assert G.cross_entropy(np.zeros((4, 3)), np.array([0, 1, 2, 0])) == pytest.approx(np.log(3))


def test_pairing_covers_all(spark):
    pos, neg = spark.range(100).withColumnRenamed("id", "sample_id"), spark.range(1000, 1030).withColumnRenamed("id", "sample_id")
    got = neural.paired(pos, neg).collect()
    assert sorted(r["pos_id"] for r in got) == list(range(100))
    use = pd.Series([r["neg_id"] for r in got]).value_counts()
    assert len(use) == 30 and set(use) <= {3, 4}


def test_accuracy(spark):
    df = spark.createDataFrame([(True, [0, 1, 2], [0, 1, 2]), (True, [0, 1, 1], [0, 1, 2]), (False, [0, 0, 1], [0, 0, 0])], "is_pos boolean, pred array<int>, target array<int>")
    got = {r["is_pos"]: r for r in neural.accuracy(df).collect()}
    assert got[True]["window_acc"] == 0.5 and got[True]["step_acc"] == pytest.approx(5 / 6) and got[False]["window_acc"] == 1.0


def net(seed=1, n=12):
    g = np.random.default_rng(seed)
    return pd.DataFrame({"net_sta": [f"N.S{i}" for i in range(n)], "lat": 35 + g.random(n), "lon": -118 + g.random(n), "ele": g.random(n) * 500})


def times(sta, lat, lon, dep, v):
    dy, dx = 111.0 * (sta.lat - lat), 111.0 * np.cos(np.radians(sta.lat.mean())) * (sta.lon - lon)
    return np.sqrt(dx**2 + dy**2 + (dep + sta.ele / 1000) ** 2) / v


def test_location(spark):
    sta, rows = net(), []
    truth = {1: (35.5, -117.5, 8.0), 2: (35.3, -117.7, 4.0)}
    for e, (lat, lon, dep) in truth.items():
        for n, p, s in zip(sta.net_sta, times(sta, lat, lon, dep, 5.9), times(sta, lat, lon, dep, 3.45)):
            rows.append((e, n, 10**15 + round(p * 1e6), 10**15 + round(s * 1e6)))
    rows.append((3, "N.S1", 10**15, None))
    ph = spark.createDataFrame(rows, "event_id long, net_sta string, tp_us long, ts_us long")
    got = {r["evid"]: r for r in location.locate(ph, spark.createDataFrame(sta), depths=(2, 8, 14)).collect()}
    assert set(got) == {1, 2}
    for e, (lat, lon, dep) in truth.items():
        assert abs(got[e]["lat"] - lat) < 0.01 and abs(got[e]["lon"] - lon) < 0.01 and abs(got[e]["dep"] - dep) < 1.0 and got[e]["is_loc"]


def test_relocation_brings_pairs_to_their_true_distance():
    sta, g = net(2), np.random.default_rng(4)
    true = np.column_stack([35.5 + g.normal(0, 0.01, 6), -117.5 + g.normal(0, 0.01, 6), 8 + g.normal(0, 0.5, 6)])
    ev = pd.DataFrame({"event_id": range(6), "lat": true[:, 0] + g.normal(0, 0.004, 6), "lon": true[:, 1] + g.normal(0, 0.004, 6), "dep": true[:, 2] + g.normal(0, 0.4, 6), "ot_us": 10**15})
    rows = []
    for i in range(6):
        for j in range(i + 1, 6):
            for ph, v in (("P", 5.9), ("S", 3.45)):
                a, b = (times(sta, *true[k], v) for k in (i, j))
                rows += [(i, j, r.lat, r.lon, r.ele, ph, x - y, 1.0) for r, x, y in zip(sta.itertuples(), a, b)]
    links = pd.DataFrame(rows, columns=["evid1", "evid2", "lat", "lon", "ele", "phase", "dt", "weight"])
    out = location.relocate_cell(ev, links, 5.9, 3.45, rounds=6, damping=1e-4)
    spread = lambda d: np.linalg.norm((d - d.mean(axis=0)) * [111, 90, 1] - (true - true.mean(axis=0)) * [111, 90, 1], axis=1).mean()
    assert spread(out[["lat", "lon", "dep"]].to_numpy()) < 0.25 * spread(ev[["lat", "lon", "dep"]].to_numpy())


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [("a" if i % 2 else "b", 1_000_000_000 + (i * i * 37) % 900) for i in range(300)]
    df = spark.createDataFrame(rows, "chn string, s long").select("chn", F.timestamp_seconds("s").alias("t"))
    last = spark.createDataFrame([("a", 2_000_000_000), ("b", 2_000_000_000)], "chn string, s long").select("chn", F.timestamp_seconds("s").alias("t"))
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    last.coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)

    def run(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    taken = [x for x in run(detect.dead_time(read(), "chn", 30_000_000), "dead") if x[1] < 2 * 10**15]
    batch = R.dead_time(df.select("chn", F.unix_micros("t").alias("t_us")), 30_000_000).collect()
    assert taken == sorted(map(tuple, batch))
    want = df.groupBy("chn", F.window("t", "20 seconds", "10 seconds")).agg(F.count("*").alias("n")).select("chn", F.col("window.start").alias("start"), "n").collect()
    assert [x for x in run(detect.window_counts(read(), "chn"), "wins") if x[1].year < 2030] == sorted(map(tuple, want))
    assert run(detect.sessions(read(), "chn"), "sess")


def test_grid_counts(spark):
    st = spark.createDataFrame(net(3))
    tt = R.travel_times(st, Association(xy_grid=0.1, z_grids=(5.0,)))
    assert tt.select("net_sta").distinct().count() == 12 and tt.where("ttp <= 0").count() == 0


def test_windows_do_not_depend_on_blocks(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    rows = [(c, i + 5, rnd.random()) for c in "ab" for i in range(300 if c == "a" else 41)]
    df = spark.createDataFrame(rows, "chn string, idx long, v double").repartition(3)
    ops = {"sta_lta": lambda x: R.sta_lta(x, 4, 20), "rolling_kurtosis": lambda x: R.rolling_kurtosis(x, 30), "first_difference": R.first_difference, "energy_norm": lambda x: R.energy_norm(x, 25)}
    for op in ops.values():
        got = []
        for block in (1 << 16, 16):
            monkeypatch.setattr(R, "BLOCK", block)
            got.append(sorted((r["chn"], r["idx"], *(None if x is None else round(x, 9) for x in r[2:])) for r in op(df).collect()))
        assert got[0] == got[1] and got[0]
