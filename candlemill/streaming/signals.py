"""Merging of signals as readings arrive, with one stored reading a symbol as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from candlemill.operators.signals import GAP_MS

OUT = "symbol string, ts_ms long, action string, confidence double, decision string"


def merge_stream(readings: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Streaming readings(symbol, ts_ms, action, confidence) with the decision on each: append, update or skip.

    A reading is appended if its action is new or the stored one lies more than gap_ms back,
    updates it if its confidence differs, and is else skipped without moving the stored time. One
    older than the stored one is skipped: what has been decided stays. State lives in the query's
    checkpoint, so a restart goes on where it stopped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        batch = pd.concat(frames).sort_values("ts_ms", kind="stable")
        said = []
        for r in batch.itertuples(index=False):
            if held is not None and r.ts_ms < held[1]:
                said.append("skip")
                continue
            new = held is None or r.action != held[0] or r.ts_ms - held[1] > gap_ms
            said.append("append" if new else "update" if r.confidence != held[2] else "skip")
            if said[-1] != "skip":
                held = (str(r.action), int(r.ts_ms), float(r.confidence))
        if held is not None:
            state.update(held)
        yield batch.assign(symbol=key[0], decision=said)[["symbol", "ts_ms", "action", "confidence", "decision"]]

    clean = readings.select("symbol", "ts_ms", "action", "confidence").where("symbol is not null and ts_ms is not null and action is not null and confidence is not null")
    return clean.groupBy("symbol").applyInPandasWithState(step, OUT, "action string, ts_ms long, confidence double", "append", GroupStateTimeout.NoTimeout)


def alerts(merged: DataFrame) -> DataFrame:
    """Only appended signals."""
    return merged.where("decision = 'append'").drop("decision")
