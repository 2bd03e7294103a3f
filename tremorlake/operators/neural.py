"""Neural picking and its training data: windows, step features, labels, inference, decoding, sampling, metrics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal as G
from ..params import Neural
from .picking import align, borrow, preprocess
from .relational import merge_neighbours

RAW = "net_sta string, tp_us long, ts_us long, s_amp double, p_prob double, s_prob double, keep boolean"


@dataclass(frozen=True)
class Weights:
    """M1: a two-layer bidirectional GRU, self-attention, and a linear layer to 3 classes; arrays as common frameworks export them.

    gru: for each layer, for each direction (w_ih, w_hh, b_ih, b_hh), gates in the order
    reset, update, new; attention: (w_qkv, b_qkv, w_out, b_out), or None without heads.
    """

    gru: tuple
    attention: tuple | None
    linear: tuple[np.ndarray, np.ndarray]
    heads: int = 4

    @classmethod
    def load(cls, path: str, heads: int = 4) -> Weights:
        z = np.load(path)
        layers = tuple(tuple(tuple(z[f"gru.{n}_l{i}{d}"] for n in ("weight_ih", "weight_hh", "bias_ih", "bias_hh")) for d in ("", "_reverse")) for i in range(2))
        att = tuple(z[f"attention.{n}"] for n in ("in_proj_weight", "in_proj_bias", "out_proj.weight", "out_proj.bias")) if heads > 0 else None
        return cls(layers, att, (z["linear.weight"], z["linear.bias"]), heads)

    @classmethod
    def random(cls, features: int = 150, hidden: int = 128, heads: int = 4, seed: int = 0) -> Weights:
        g = np.random.default_rng(seed)
        w = lambda *s: g.normal(0, 1 / np.sqrt(s[-1]), s)
        layers = tuple(tuple((w(3 * hidden, n), w(3 * hidden, hidden), w(3 * hidden), w(3 * hidden)) for _ in range(2)) for n in (features, 2 * hidden))
        d = 2 * hidden
        return cls(layers, (w(3 * d, d), w(3 * d), w(d, d), w(d)) if heads > 0 else None, (w(3, d), w(3)), heads)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _gru(x: np.ndarray, w_ih, w_hh, b_ih, b_hh) -> np.ndarray:
    gates, h, out = x @ w_ih.T + b_ih, np.zeros((len(x), w_hh.shape[1])), []
    for t in range(x.shape[1]):
        r, z, n = np.split(gates[:, t], 3, axis=1)
        hr, hz, hn = np.split(h @ w_hh.T + b_hh, 3, axis=1)
        z = _sigmoid(z + hz)
        h = (1 - z) * np.tanh(n + _sigmoid(r + hr) * hn) + z * h
        out.append(h)
    return np.stack(out, axis=1)


def infer(x: np.ndarray, w: Weights) -> np.ndarray:
    """Logits (windows, steps, 3) of step features (windows, steps, features)."""
    for forward, backward in w.gru:
        x = np.concatenate([_gru(x, *forward), _gru(x[:, ::-1], *backward)[:, ::-1]], axis=2)
    if w.attention is not None:
        w_in, b_in, w_out, b_out = w.attention
        q, k, v = (y.reshape(*x.shape[:2], w.heads, -1).transpose(0, 2, 1, 3) for y in np.split(x @ w_in.T + b_in, 3, axis=2))
        a = G.softmax(q @ k.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1])) @ v
        x = a.transpose(0, 2, 1, 3).reshape(x.shape) @ w_out.T + b_out
    return x @ w.linear[0].T + w.linear[1]


def step_features(window: np.ndarray, q: Neural) -> np.ndarray:
    """(steps, components * step samples) of a window (components, samples)."""
    n, stride = int(q.step_len * q.samp_rate), int(q.step_stride * q.samp_rate)
    w = np.lib.stride_tricks.sliding_window_view(window, n, axis=1)[:, ::stride]
    return w.transpose(1, 0, 2).reshape(w.shape[1], -1)


def normalise(window: np.ndarray, missing: np.ndarray, whole: bool = True) -> np.ndarray:
    """Missing components borrow the last other one; less the mean, over the largest value of all (or of each) component."""
    if missing.any() and not missing.all():
        window = window[np.where(missing, np.flatnonzero(~missing)[-1], np.arange(len(window)))]
    window = window - window.mean(axis=1, keepdims=True)
    top = np.abs(window).max() if whole else np.abs(window).max(axis=1, keepdims=True)
    return window / np.where(top == 0, 1, top)


def islands(prob: np.ndarray, least: float) -> list[tuple[float, float]]:
    """(median step, largest probability) of each run of steps of probability `least` or more."""
    at = np.flatnonzero(prob >= least)
    return [(float(np.median(run)), float(prob[run].max())) for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1) if len(run)]


def decode(prob: np.ndarray, q: Neural) -> list[tuple[float, float, float, float]]:
    """(tp, ts, p_prob, s_prob) of pairs with S after P, in seconds from the window's start."""
    p, s = np.nan_to_num(prob[:, 1]), np.nan_to_num(prob[:, 2])
    if min(p.max(), s.max()) < q.trig_thres:
        return []
    time = lambda step: q.step_len / 2 + q.step_stride * step
    return [(time(a), time(b), pa, pb) for a, pa in islands(p, q.trig_thres) for b, pb in islands(s, q.trig_thres) if b > a]


def is_glitch(data: np.ndarray, p: int, s: int, rate: float, q: Neural) -> bool:
    """too sharp a peak in P or S, or P too large against what follows it or S; an equal peak ratio passes, an equal A12 or A13 does not."""
    n, half = int(q.win_peak * rate), (s - p) / 2
    peaks = [min(G.peak_ratios(data[:, x : x + 3 * n + 1], n)) for x in (p, s)]
    part = lambda a, b: [G.spread(x) for x in data[:, round(a) : round(b) + 1]]
    a1, a2, a3 = part(p, p + half), part(p + half, s), part(s, s + half)
    return max(peaks) > q.amp_ratio_thres[0] or not (min(map(G.ratio, a1, a2)) < q.amp_ratio_thres[1] and min(map(G.ratio, a1, a3)) < q.amp_ratio_thres[2])


def pick_station(start_us: int, data: np.ndarray, rate: float, model, q: Neural, batch: int = 20) -> list[tuple]:
    """S8 of one station-day before merging: (tp_us, ts_us, s_amp, p_prob, s_prob, keep); model: (windows, steps, features) -> logits.

    W5: windows win_stride apart, the first one a stride after the start; windows whose
    components are all missing (a quarter of their samples 0) are left out (F17).
    """
    raw = G.clean(data)
    ready = preprocess(raw, rate, (1.0, 20.0), 5.0, least_gap=10)
    if ready is None:
        return []
    if rate != q.samp_rate:
        ready = np.array([G.resample(x, rate, q.samp_rate) for x in ready])
    skip, n, stride = int(q.win_stride * q.samp_rate), int(q.win_len * q.samp_rate), int(q.win_stride * q.samp_rate)
    ready, begin = ready[:, skip:], start_us + round(q.win_stride * 1e6)
    raw = raw[:, int(q.win_stride * rate) :]
    count = (ready.shape[1] - n) // stride + 1
    found = []
    for lo in range(0, max(0, count), batch):
        own, seqs = [], []
        for i in range(lo, min(lo + batch, count)):
            piece = raw[:, int(i * q.win_stride * rate) : int((i * q.win_stride + q.win_len) * rate)]
            missing = (piece == 0).sum(axis=1) > q.win_len * rate / 4
            if not missing.all():
                own.append(i)
                seqs.append(step_features(normalise(ready[:, i * stride : i * stride + n], missing), q))
        if seqs:
            for i, prob in zip(own, G.softmax(model(np.array(seqs))), strict=True):
                found += [(i * q.win_stride + tp, i * q.win_stride + ts, a, b) for tp, ts, a, b in decode(prob, q)]
    out = []
    for tp, ts, a, b in found:
        p, s = round(tp * q.samp_rate), round(ts * q.samp_rate)
        part = ready[:, max(0, p - int(q.amp_win[0] * q.samp_rate)) :][:, : int(sum(q.amp_win) * q.samp_rate)]
        keep = not (q.rm_glitch and is_glitch(ready, p, s, q.samp_rate, q))
        out.append((begin + round(tp * 1e6), begin + round(ts * 1e6), G.displacement_peak(part, q.samp_rate), a, b, keep))
    return out


def pick(traces: DataFrame, weights: Weights, q: Neural = Neural()) -> DataFrame:
    """Picks of traces (day, net_sta, chn, start_us, rate, data); pairs of overlapping windows are merged by probability (J6, A8), glitches go after that."""
    shared = traces.sparkSession.sparkContext.broadcast(weights)  # the model: of fixed size

    def station_day(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        pdf = pdf.sort_values("chn")
        if len(pdf) == 3 and pdf.rate.nunique() == 1:
            rate = float(pdf.rate.iloc[0])
            start, data = align([int(x) for x in pdf.start_us], rate, [np.asarray(x, dtype=float) for x in pdf.data])
            rows = [(pdf.net_sta.iloc[0], *r) for r in pick_station(start, borrow(data), rate, lambda x: infer(x, shared.value), q)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])

    raw = traces.select("day", "net_sta", "chn", "start_us", "rate", "data").groupBy("day", "net_sta").applyInPandas(station_day, RAW)
    return merge_neighbours(raw, round(q.tp_dev * 1e6), round(q.ts_dev * 1e6)).where("keep").drop("keep")


# training data -------------------------------------------------------------------------
def split_of(key, valid_share: float = 0.1):
    """M6: 'train' or 'valid' by a hash of the key, the same on every run."""
    return F.when(F.pmod(F.xxhash64(key), F.lit(10_000)) < int(valid_share * 10_000), "valid").otherwise("train")


def augment(picks: DataFrame, q: Neural, num_aug: int = 2, seed: int = 1) -> DataFrame:
    """M7: windows (t0_us) around picks: num_aug for training, one for validation, P at a place drawn by a hash of pick and number."""
    own = picks.withColumn("split", split_of(F.concat_ws(":", "net_sta", "tp_us"))).withColumn("aug", F.explode(F.sequence(F.lit(1), F.when(F.col("split") == "train", num_aug).otherwise(1))))
    u = F.pmod(F.xxhash64("net_sta", "tp_us", "aug", F.lit(seed)), F.lit(1_000_003)).cast("double") / 1_000_003
    room = F.least(F.lit(q.win_len / 2 - q.step_len), F.lit(q.win_len - q.step_len) - (F.col("ts_us") - F.col("tp_us")) / 1e6)
    return own.where(room > 0).withColumn("t0_us", F.col("tp_us") - F.round((q.step_len + u * room) * 1e6).cast("long"))


def paired(positives: DataFrame, negatives: DataFrame, seed: int = 1) -> DataFrame:
    """M3: each positive with a negative: both in hash order, negatives over again where they are fewer. sample_id is unique on each side.

    Ranks come from hash buckets, so no task ranks all rows.
    """

    def ranked(df: DataFrame, salt: int, name: str) -> tuple[DataFrame, DataFrame]:
        h = df.withColumn("h", F.xxhash64("sample_id", F.lit(salt))).withColumn("b", F.shiftrightunsigned("h", 52).cast("int"))
        size = h.groupBy("b").count()
        before = size.select("b", (F.sum("count").over(Window.orderBy("b")) - F.col("count")).alias("before"))  # 4096 buckets
        return h.join(F.broadcast(before), "b").select((F.row_number().over(Window.partitionBy("b").orderBy("h", "sample_id")) - 1 + F.col("before")).alias("rk"), F.col("sample_id").alias(name)), size.agg(F.sum("count").alias("n"))

    p, _ = ranked(positives, seed, "pos_id")
    n, total = ranked(negatives, seed + 1, "neg_id")
    return p.join(F.broadcast(total)).withColumn("rk", F.pmod("rk", "n")).join(n, "rk").select("pos_id", "neg_id")


def add_noise(data: np.ndarray, noise: np.ndarray, p: int, s: int, share: float) -> np.ndarray:
    """Noise scaled to `share` of the largest value between P and S."""
    top = np.abs(data[:, p : max(s, p + 1)]).max()
    scale = np.abs(noise).max()
    return data + noise * (share * top / scale if scale else 0.0)


def likely_event(data: np.ndarray, win_len: int) -> bool:
    """every component's largest value is in the second half."""
    return bool((np.abs(data).argmax(axis=1) > win_len // 2).all())


def accuracy(predictions: DataFrame) -> DataFrame:
    """A14 of (is_pos, pred array<int>, target array<int>): step accuracy, and the share of right windows; positive: a P step and an S step."""
    same = F.aggregate(F.zip_with("pred", "target", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    found = F.array_contains("pred", 1) & F.array_contains("pred", 2)
    right = F.when(F.col("is_pos"), found).otherwise(~found).cast("double")
    return predictions.groupBy("is_pos").agg(F.count("*").alias("n"), (F.sum(same) / F.sum(F.size("target"))).alias("step_acc"), F.avg(right).alias("window_acc"))
