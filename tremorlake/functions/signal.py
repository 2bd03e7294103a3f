"""NumPy kernels on samples of one trace or of three components."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def clean(x: np.ndarray) -> np.ndarray:
    """F8: no number and infinite become 0."""
    return np.where(np.isfinite(x), x, 0.0)


def zero_runs(x: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, last) places of runs of `least` zero differences or more."""
    flat = np.flatnonzero(np.diff(x) == 0)
    if not len(flat):
        return []
    cuts = np.flatnonzero(np.diff(flat) != 1)
    firsts, lasts = flat[np.append(0, cuts + 1)], flat[np.append(cuts, len(flat) - 1)]
    return [(int(a), int(b)) for a, b in zip(firsts, lasts, strict=True) if b - a + 1 >= least]


def fill_gaps(x: np.ndarray, max_gap: int, least: int = 3) -> np.ndarray:
    """Flat runs give way to the data after them: as much as the run is long, max_gap samples, or up to the next run, repeated where that is shorter."""
    x, last = x.copy(), len(x) - 1
    runs = zero_runs(x, least)
    for i, (first, end) in enumerate(runs):
        follower = runs[i + 1][0] if i + 1 < len(runs) else last
        lo, hi = max(0, first - 1), min(last, end + 1)
        source = x[hi : min(hi + (hi - lo), hi + max_gap, follower)]
        if len(source):
            x[lo:hi] = np.resize(source, hi - lo)
    return x


def detrend(x: np.ndarray) -> np.ndarray:
    """Less its mean and its least-squares line."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    x = x - x.mean()
    return x - t * (t @ x) / max(t @ t, 1e-300)


def taper(x: np.ndarray, rate: float, share: float = 0.05, longest: float = 5.0) -> np.ndarray:
    """Cosine ramps over a share of each end, `longest` seconds at most."""
    n = int(min(share * len(x), longest * rate))
    if n < 1:
        return x
    ramp = 0.5 * (1 - np.cos(np.pi * np.arange(n) / n))
    x = x.copy()
    x[:n] *= ramp
    x[len(x) - n :] *= ramp[::-1]
    return x


@lru_cache(maxsize=16)
def butterworth(lo: float | None, hi: float | None, rate: float, order: int = 4) -> tuple[tuple[float, ...], ...]:
    """Second-order sections (b0, b1, b2, a1, a2) of a Butterworth band-, high- or low-pass, by the bilinear transform."""
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    warp = lambda f: 2 * np.tan(np.pi * min(f / rate, 0.499999))
    if lo and hi:
        w0, bw = np.sqrt(warp(lo) * warp(hi)), warp(hi) - warp(lo)
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2)
        poles, zeros, ones = np.concatenate([half + root, half - root]), [1.0] * order, [-1.0] * order
        gain, f0 = bw**order, w0
    elif lo:
        w0 = warp(lo)
        poles, zeros, ones, gain, f0 = w0 / poles, [1.0] * order, [], 1.0, None
    else:
        w0 = warp(hi)
        poles, zeros, ones, gain, f0 = poles * w0, [], [-1.0] * order, w0**order, 0.0
    z = (2 + poles) / (2 - poles)
    roots = [*zeros, *ones]
    up = sorted((p for p in z if p.imag > 1e-12), key=lambda p: abs(p))
    real = sorted((p.real for p in z if abs(p.imag) <= 1e-12), key=abs)
    pairs = [(p, p.conjugate()) for p in up] + [(real[i], real[i + 1] if i + 1 < len(real) else 0.0) for i in range(0, len(real), 2)]
    mixed = sorted(roots, key=lambda r: roots.index(r))
    mixed = [x for pair in zip(mixed[: len(mixed) // 2], mixed[len(mixed) // 2 :], strict=True) for x in pair] if lo and hi else mixed
    sections = []
    for i, (p, q) in enumerate(pairs):
        r = mixed[2 * i : 2 * i + 2]
        b = np.poly(r) if r else np.array([1.0])
        b = np.pad(b, (0, 3 - len(b)))
        a = np.real(np.poly([p, q]))
        sections.append([*np.real(b), a[1], a[2]])
    # unit gain in the middle of the band
    w = 0.0 if f0 == 0.0 else np.pi if f0 is None else 2 * np.arctan(f0 / 2)
    e = np.exp(-1j * w * np.arange(3))
    total = np.prod([abs((np.array(s[:3]) @ e) / (np.array([1, *s[3:]]) @ e)) for s in sections])
    sections[0][:3] = [x / total for x in sections[0][:3]]
    assert gain > 0
    return tuple(tuple(s) for s in sections)


def _section(x: np.ndarray, b0: float, b1: float, b2: float, a1: float, a2: float) -> np.ndarray:
    """One recursive section, in blocks: the state's effect on a block is a fixed matrix, so only blocks are walked in Python."""
    n = 256
    v = b0 * x
    v[1:] += b1 * x[:-1]
    v[2:] += b2 * x[:-2]
    h = np.zeros(n + 1)
    h[0] = 1
    for i in range(1, n + 1):
        h[i] = -a1 * h[i - 1] - a2 * (h[i - 2] if i > 1 else 0)
    i = np.arange(n)
    matrix = np.where(i[:, None] >= i[None, :], h[np.abs(i[:, None] - i[None, :])], 0.0)
    from1, from2 = h[1 : n + 1], -a2 * h[:n]  # effect of y[-1] and of y[-2]
    blocks = -(-len(v) // n)
    y = np.pad(v, (0, blocks * n - len(v))).reshape(blocks, n) @ matrix.T
    y1 = y2 = 0.0
    for k in range(blocks):
        y[k] += from1 * y1 + from2 * y2
        y1, y2 = y[k, -1], y[k, -2]
    return y.reshape(-1)[: len(v)]


def band_filter(x: np.ndarray, rate: float, lo: float | None, hi: float | None) -> np.ndarray:
    """Causal fourth-order Butterworth; without corners nothing is supported."""
    if not lo and not hi:
        raise ValueError("a corner frequency is needed")
    if hi and hi >= rate / 2:
        hi = None
        if not lo:
            return x
    x = x.astype(float)
    for s in butterworth(lo or None, hi or None, rate):
        x = _section(x, *s)
    return x


def resample(x: np.ndarray, rate: float, to: float) -> np.ndarray:
    """By the spectrum, to round(n * to / rate) samples."""
    n, m = len(x), int(len(x) * to / rate)
    if m == n or n == 0:
        return x
    f = np.fft.rfft(x)
    out = np.zeros(m // 2 + 1, dtype=complex)
    k = min(len(f), len(out))
    out[:k] = f[:k]
    return np.fft.irfft(out, m) * (m / n)


def sta_lta(x: np.ndarray, nl: int, ns: int) -> np.ndarray:
    """Mean of the ns samples after each over the mean of the nl up to it; 0 where undefined; a single 0 for a short trace."""
    n = len(x)
    if n < nl + ns:
        return np.zeros(1)
    c = np.concatenate([[0.0], np.cumsum(x)])
    out = np.zeros(n)
    i = np.arange(nl, n)
    lta = (c[i + 1] - c[i + 1 - nl]) / nl
    sta = np.zeros(len(i))
    ok = i < n - ns
    sta[ok] = (c[i[ok] + ns + 1] - c[i[ok] + 1]) / ns
    with np.errstate(divide="ignore", invalid="ignore"):
        out[nl:] = clean(sta / lta)
    return out


def rolling_kurtosis(x: np.ndarray, n: int) -> np.ndarray:
    """Excess kurtosis of each full window of n samples."""
    if len(x) < n:
        return np.zeros(max(0, len(x) - n + 1))
    w = np.lib.stride_tricks.sliding_window_view(x, n)
    d = w - w.mean(axis=1, keepdims=True)
    m2 = (d * d).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (d**4).mean(axis=1) / m2**2 - 3


def _turns(x: np.ndarray) -> tuple[int, int]:
    """How far the first and the second turning point are; 0, 0 for a monotone sequence."""
    if len(x) < 2:
        return 0, 0
    up = np.diff(x) >= 0
    if not (np.diff(x) < 0).any() or not (np.diff(x) > 0).any():
        return 0, 0
    first = int(np.argmax(up != up[0]))
    later = up[first + 1 :]
    seen_up, seen_down = np.flatnonzero(later), np.flatnonzero(~later)
    if not len(seen_up) or not len(seen_down):
        return first, first
    return first, first + 1 + int(max(seen_up[0], seen_down[0]))


def first_turn(x: np.ndarray) -> int:
    return _turns(x)[0]


def second_turn(x: np.ndarray) -> int:
    return _turns(x)[1]


def polarization(window: np.ndarray) -> tuple[float, np.ndarray]:
    """Linearity and main direction of three components."""
    value, vector = np.linalg.eigh(np.cov(window))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - 0.5 * abs(value.sum() - value[-1]) / abs(value[-1]), vector[:, -1]


def pca_weights(data: np.ndarray, p: int, before: int, after: int, n: int) -> np.ndarray:
    """1 - linearity * |cos| to the P direction for windows that begin before .. after samples around p."""
    _, direction = polarization(data[:, p : p + n])
    got = [polarization(data[:, i : i + n]) for i in range(p - before, p + after)]
    return np.array([1 - r * abs(direction @ v) for r, v in got])


def displacement_peak(velocity: np.ndarray, rate: float) -> float:
    """The largest vector displacement of demeaned velocities."""
    d = np.cumsum(velocity - velocity.mean(axis=1, keepdims=True), axis=1) / rate
    return float(np.sqrt((d * d).sum(axis=0).max()))


def dominant_frequency(x: np.ndarray, rate: float) -> float:
    """The strongest frequency of the first half of the spectrum."""
    if len(x) < 2:
        return 0.0
    return float(np.argmax(np.abs(np.fft.fft(x - x.mean())[: len(x) // 2]) ** 2) * rate / len(x))


def spread(x: np.ndarray) -> float:
    return float(x.max() - x.min()) if x.size else 0.0


def ratio(a: float, b: float) -> float:
    return a / b if b else (np.inf if a else np.nan)


def peak_ratios(data: np.ndarray, n: int) -> list[float]:
    """For each component, the range around the largest early peak over the range as long after it."""
    early = np.abs(data[:, :n])
    c = int(np.unravel_index(np.argmax(early), early.shape)[0])
    x, top = data[c], int(np.argmax(early[c]))
    right = top + first_turn(x[top:])
    right += second_turn(x[right:]) + 1
    left = max(0, top - second_turn(x[:top][::-1]))
    return [ratio(spread(y[left:right]), spread(y[right : 2 * right - left])) for y in data]


def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised correlation of (channels, n) with (channels, m) at lags 0 .. n - m, averaged over channels."""
    m, out = y.shape[1], 0
    for a, b in zip(x, y, strict=True):
        energy = np.concatenate([[0.0], np.cumsum(a * a)])
        with np.errstate(divide="ignore", invalid="ignore"):
            out = out + clean(np.correlate(a, b, "valid") / (np.sqrt(np.maximum(energy[m:] - energy[:-m], 0)) * np.sqrt(b @ b)))
    return out / len(x)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def cross_entropy(logits: np.ndarray, target: np.ndarray) -> float:
    """Mean over steps."""
    p = softmax(logits)
    return float(-np.log(np.maximum(np.take_along_axis(p, target[..., None], -1), 1e-300)).mean())
