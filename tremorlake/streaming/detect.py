"""Structured Streaming counterparts: window counts, sessions of picks, dead time per channel.

Each takes a streaming DataFrame with an event time t (timestamp). Late rows are dropped
by the watermark; state is kept by key and ends with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(stream: DataFrame, by: str, late: str = "1 minute", length: str = "20 seconds", slide: str = "10 seconds") -> DataFrame:
    """Picks by sliding window."""
    return stream.withWatermark("t", late).groupBy(by, F.window("t", length, slide)).agg(F.count("*").alias("n")).select(by, F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, by: str, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of picks with less than gap between them."""
    return stream.withWatermark("t", late).groupBy(by, F.session_window("t", gap)).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), "n")


def dead_time(stream: DataFrame, by: str, gap_us: int, late: str = "1 minute") -> DataFrame:
    """Of each channel the first time, then each first one more than gap_us after the last taken.

    A row is judged once the watermark has passed it, so rows that come out of order within
    `late` are judged in time order. State: the waiting times and the last one taken.
    """

    def judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (-(2**62), [])
        waiting = list(waiting)
        for pdf in batches:
            waiting += [int(x.value // 1000) if x.unit == "ns" else int(x.timestamp() * 1e6) for x in pdf["t"]]
        mark = state.getCurrentWatermarkMs() * 1000
        out, rest = [], []
        for t in sorted(waiting):
            if t > mark:
                rest.append(t)
            elif t > last + gap_us:
                out.append(t)
                last = t
        state.update((last, rest))
        if rest:
            state.setTimeoutTimestamp(max(min(rest) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({by: [key[0]] * len(out), "t_us": out})

    marked = stream.withWatermark("t", late)
    return marked.select(by, "t").groupBy(by).applyInPandasWithState(judge, f"{by} string, t_us long", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
