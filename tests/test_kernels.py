import numpy as np
import pandas as pd
import pytest

from tremorlake.functions import signal as G
from tremorlake.operators.association import TravelTimes, associate, associate_day
from tremorlake.operators.correlation import correlate, differential_time, phase_windows
from tremorlake.operators.picking import pick, pick_trace, preprocess
from tremorlake.params import Association, Pairing, Picking

RATE = 100.0


def test_sta_lta_and_kurtosis_by_definition():
    x = np.random.default_rng(0).random(400)
    got = G.sta_lta(x, 60, 8)
    for i in range(400):
        want = 0.0 if i < 60 else (x[i + 1 : i + 9].mean() if i < 392 else 0) / x[i - 59 : i + 1].mean()
        assert got[i] == pytest.approx(want)
    assert G.sta_lta(x[:60], 60, 8).tolist() == [0.0]
    k = G.rolling_kurtosis(x, 50)
    d = x[7:57] - x[7:57].mean()
    assert len(k) == 351 and k[7] == pytest.approx((d**4).mean() / (d * d).mean() ** 2 - 3)


def test_filter_response():
    t = np.arange(6000) / RATE
    for f, keep in ((0.1, 0), (5, 1), (45, 0)):
        y = G.band_filter(np.sin(2 * np.pi * f * t), RATE, 1, 20)[3000:]
        assert np.abs(y).max() == pytest.approx(keep, abs=0.05)
    for lo, hi, f, keep in ((2, None, 0.2, 0), (2, None, 20, 1), (None, 5, 0.5, 1), (None, 5, 30, 0)):
        y = G.band_filter(np.sin(2 * np.pi * f * t), RATE, lo, hi)[3000:]
        assert np.abs(y).max() == pytest.approx(keep, abs=0.05)
    # corners of a Butterworth pass half the power
    assert np.sqrt(2 * np.mean(G.band_filter(np.sin(2 * np.pi * 20 * t), RATE, 1, 20)[3000:] ** 2)) == pytest.approx(0.5**0.5, abs=0.01)


def test_gaps():
    x = np.arange(20.0)
    x[5:10] = 4.0
    y = G.fill_gaps(x, 500)
    assert np.all(np.diff(G.zero_runs(y, 3) or [(0, 0)]) >= 0) and not G.zero_runs(y, 3)
    assert G.fill_gaps(np.array([1.0, 2, 2, 2, 3, 4]), 500).tolist() == [1, 2, 2, 2, 3, 4]


def test_turns():
    assert G.first_turn(np.array([1, 3, 2, 5.0])) == 1
    assert G.second_turn(np.array([1, 3, 2, 5, 1.0])) == 3
    assert G.second_turn(np.array([1, 2, 3.0])) == 0 and G.second_turn(np.zeros(1)) == 0


def wave(seed, p, s, n=6000):
    g = np.random.default_rng(seed)
    out = g.normal(0, 0.01, (3, n))
    t = np.arange(n) / RATE
    for c in range(3):
        for at, amp, f in ((p, 1.0 if c == 2 else 0.25, 8), (s, 0.5 if c == 2 else 4.0, 5)):
            u = np.maximum(t - at / RATE, 0)
            out[c] += amp * np.sin(2 * np.pi * f * u + 0.1) * np.exp(-u / 1.2) * (t >= at / RATE)
    return out


def test_picker_finds_planted_phases(spark):
    rows = []
    for i, (p, s) in enumerate([(2500, 2900), (2200, 2750)]):
        for c, x in enumerate(wave(i, p, s)):
            rows.append((18000, f"N.S{i}", c, 10**15, RATE, x.tolist()))
    rows.append((18000, "N.ONE", 0, 10**15, RATE, [0.0] * 100))
    df = spark.createDataFrame(rows, "day long, net_sta string, chn int, start_us long, rate double, data array<double>")
    got = {r["net_sta"]: r for r in pick(df, Picking(amp_ratio_thres=(1e9, 1e9, 1e9))).collect()}
    assert set(got) == {"N.S0", "N.S1"}
    for i, (p, s) in enumerate([(2500, 2900), (2200, 2750)]):
        r = got[f"N.S{i}"]
        assert abs((r["tp_us"] - 10**15) / 1e4 - p) <= 15
        assert abs((r["ts_us"] - 10**15) / 1e4 - s) <= 60
        assert r["tp_us"] > r["sta_ot_us"] and r["s_amp"] > 0 and r["p_snr"] > 12


def test_silent_traces_have_no_picks():
    assert preprocess(np.zeros((3, 1000)), RATE, (1, 20), 5.0) is None
    assert pick_trace(np.random.default_rng(1).normal(size=(3, 6000)), RATE) == []


def network(seed=3, n_events=6):
    g = np.random.default_rng(seed)
    sta = pd.DataFrame({"net_sta": [f"N.S{i:02d}" for i in range(14)], "lat": 35 + g.random(14), "lon": -118 + g.random(14), "ele": g.random(14) * 1000})
    p = Association(xy_grid=0.04)
    tt = TravelTimes(sta, p)
    picks, truth = [], []
    for e in range(n_events):
        cell = int(g.integers(0, tt.table.shape[1]))
        ot = 10**15 + e * 60_000_000
        truth.append((ot, *tt.place(cell)))
        for i in range(14):
            if g.random() < 0.85:
                t = tt.table[i, cell]
                tp = ot + round(t * 1e6)
                picks.append((11574, sta.net_sta[i], ot + int(g.integers(-100_000, 100_000)), tp, tp + round(t * 0.7e6), 1e-5))
    for _ in range(30):
        tp = 10**15 + int(g.integers(0, 400_000_000))
        picks.append((11574, f"N.S{int(g.integers(0, 14)):02d}", tp - 3_000_000, tp, tp + 2_000_000, 1e-5))
    picks.append((11574, "X.UNKNOWN", 10**15, 10**15, 10**15, 1e-5))
    return sta, p, picks, truth


def test_association_recovers_hypocentres(spark):
    sta, p, picks, truth = network()
    df = spark.createDataFrame(picks, "day long, net_sta string, sta_ot_us long, tp_us long, ts_us long, s_amp double").repartition(3)
    got = associate(df, spark.createDataFrame(sta), p).collect()
    used = [(n, t) for r in got for n, t in zip(r["net_sta"], r["tp_us"])]
    assert len(used) == len(set(used))
    assert all(r["n_picks"] >= p.min_sta for r in got)
    for ot, lat, lon, dep in truth:
        near = [r for r in got if abs(r["ot_us"] - ot) < 300_000]
        assert near and min(abs(r["lat"] - lat) + abs(r["lon"] - lon) for r in near) < 0.25


def test_association_of_nothing():
    sta, p, picks, _ = network()
    tt = TravelTimes(sta, p)
    frame = pd.DataFrame(picks[:3], columns=["day", "net_sta", "sta_ot_us", "tp_us", "ts_us", "s_amp"])
    assert associate_day(frame, tt) == [] and associate_day(frame.iloc[:0], tt) == []


def test_correlation_shift(spark):
    p = Pairing(samp_rate=RATE)
    base = wave(5, 1000, 1500, 3000)
    rows = []
    for evid, k in ((1, 0), (2, 7)):
        x = np.roll(base, k, axis=1)
        rows.append((evid, "N.S1", 10**15, 10**15, 10**15 + 10_000_000, 10**15 + 15_000_000, x.tolist()))
    wf = spark.createDataFrame(rows, "evid long, net_sta string, start_us long, ot_us long, tp_us long, ts_us long, data array<array<double>>")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 1)], "evid1 long, evid2 long")
    got = {(r["evid1"], r["evid2"], r["phase"]): r for r in correlate(pairs, phase_windows(wf, p), p).collect()}
    for ph in "PS":
        assert got[(1, 2, ph)]["dt"] == pytest.approx(-0.07, abs=1e-9)
        assert got[(2, 1, ph)]["dt"] == pytest.approx(0.07, abs=1e-9)
        assert got[(1, 1, ph)]["dt"] == pytest.approx(0, abs=1e-9) and got[(1, 1, ph)]["cc"] == pytest.approx(1)
    x = np.random.default_rng(2).normal(size=(1, 300))
    assert differential_time(x, x[:, 50:200], 3, 3, 0.5, RATE, True)[0] == pytest.approx(-0.01)


def test_location_query_tries_all_depths(monkeypatch):
    import inspect
    from types import SimpleNamespace

    from tremorlake.plans import kernel_queries as K

    form, asked = inspect.signature(K.location.locate), []

    def locate(*args, **named):
        bound = form.bind(*args, **named)
        bound.apply_defaults()
        asked.append(bound.arguments["depths"])
        return SimpleNamespace(select=lambda *c: c)

    monkeypatch.setattr(K.location, "locate", locate)
    monkeypatch.setattr(K, "A", SimpleNamespace(phases=lambda s, d: None, stations=lambda s, d: None))
    K.absolute_location(None, "")
    assert asked == [tuple(range(20))]
