"""Streaming guard against bursts: a decaying count per actor."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def guard(state: tuple[float, int, bool] | None, ts: int, half_life_ms: float, trip: float) -> tuple[float, int, bool]:
    """One op: the count halves every half-life and grows by 1; it trips at `trip` and clears below a quarter of it."""
    c, last, tripped = state or (0.0, ts, False)
    decayed = c * 2.0 ** (-(ts - last) / half_life_ms)
    tripped = tripped and decayed >= trip / 4
    c = decayed + 1
    return c, ts, tripped or c >= trip


def decay_guard(ops: DataFrame, half_life_ms: float, trip: float, watermark: str = "1 second") -> DataFrame:
    """actor, ts_ms, c, tripped for each op of a stream (actor, ts, op_id)."""

    def run(key: tuple, parts: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "op_id"])
        out = []
        for ts in (rows["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist():
            now = guard(now, ts, half_life_ms, trip)
            out.append((key[0], ts, now[0], now[2]))
        state.update(now)
        yield pd.DataFrame(out, columns=["actor", "ts_ms", "c", "tripped"])

    return ops.withWatermark("ts", watermark).groupBy("actor").applyInPandasWithState(run, "actor string, ts_ms long, c double, tripped boolean", "c double, ts long, tripped boolean", "append", GroupStateTimeout.NoTimeout)
