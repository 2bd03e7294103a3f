"""Differential times of event pairs by waveform cross-correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal as G
from ..params import Pairing

WINDOWS = "evid long, net_sta string, phase string, tt double, shift double, data array<array<double>>, temp array<array<double>>"


def cut(data: np.ndarray, rate: float, at: float, before: float, after: float) -> np.ndarray | None:
    """Samples from `before` seconds ahead of `at`; None where the trace has not all of them."""
    lo, n = round((at - before) * rate), int((before + after) * rate)
    return data[:, lo : lo + n] if lo >= 0 and lo + n <= data.shape[1] else None


def phase_windows(waveforms: DataFrame, p: Pairing = Pairing()) -> DataFrame:
    """Data and template windows around P (Z alone) and S (E, N) of event waveforms (evid, net_sta, start_us, ot_us, tp_us, ts_us, data: E, N, Z).

    Waveforms are preprocessed before; a phase without a time, or whose windows pass the
    trace's ends, has none.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                data = np.array([np.asarray(x, dtype=float) for x in r.data])
                for phase, t, part, wd, wt in (("P", r.tp_us, data[2:3], p.win_data_p, p.win_temp_p), ("S", r.ts_us, data[:2], p.win_data_s, p.win_temp_s)):
                    if pd.isna(t):
                        continue
                    at = (int(t) - int(r.start_us)) / 1e6
                    x, y = cut(part, p.samp_rate, at, *wd), cut(part, p.samp_rate, at, *wt)
                    if x is not None and y is not None:
                        rows.append((r.evid, r.net_sta, phase, (int(t) - int(r.ot_us)) / 1e6, wd[0] - wt[0], x.tolist(), y.tolist()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    return waveforms.mapInPandas(run, WINDOWS)


def differential_time(data: np.ndarray, temp: np.ndarray, data_tt: float, temp_tt: float, shift: float, rate: float, compat: bool = False) -> tuple[float, float]:
    """(dt, cc) at the largest correlation; in compatibility mode lag 0 is left out without counting it, which makes dt one sample less (Q4)."""
    cc = G.correlation(data, temp)[1 if compat else 0 :]
    at = int(np.argmax(cc))
    return data_tt - shift + at / rate - temp_tt, float(cc[at])


def correlate(pairs: DataFrame, windows: DataFrame, p: Pairing = Pairing(), compat: bool = False) -> DataFrame:
    """(evid1, evid2, sta, phase, dt, cc) of pairs at stations and phases that both events have.

    Low correlations and large times are left out; an exact 0 stays, but for compatibility
    mode (Q5). Joins are on (event, station, phase), so a pair's stations are dealt apart.
    """
    a = windows.select(F.col("evid").alias("evid1"), "net_sta", "phase", F.col("tt").alias("tt1"), "shift", "data")
    b = windows.select(F.col("evid").alias("evid2"), "net_sta", "phase", F.col("tt").alias("tt2"), "temp")
    both = pairs.select("evid1", "evid2").join(a, "evid1").join(b, ["evid2", "net_sta", "phase"])

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                x, y = (np.array([np.asarray(c, dtype=float) for c in z]) for z in (r.data, r.temp))
                dt, cc = differential_time(x, y, r.tt1, r.tt2, r.shift, p.samp_rate, compat)
                if cc >= p.cc_thres and abs(dt) <= p.dt_thres[0 if r.phase == "P" else 1] and (dt or not compat):
                    rows.append((r.evid1, r.evid2, r.net_sta.split(".")[-1], r.phase, dt, cc))
            yield pd.DataFrame(rows, columns=["evid1", "evid2", "sta", "phase", "dt", "cc"])

    return both.mapInPandas(run, "evid1 long, evid2 long, sta string, phase string, dt double, cc double")
