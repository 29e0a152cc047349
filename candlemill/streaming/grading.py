"""Grading of open signals as bars arrive, with the open ones of a symbol as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from candlemill.operators.grading import DAY_WINDOW_MS

OUT = "symbol string, sid string, status string, resolved_price double, resolved_ms long, mfe double, mae double"
FEED = "symbol string, ts_ms long, sid string, action string, entry double, target double, stop double, h double, l double, c double"


def feed(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """One stream of signals(sid, symbol, ts_ms, action, entry, target, stop) and bars(symbol, ts_ms, h, l, c)."""
    names = [(x.split()[0], x.split()[1]) for x in FEED.split(", ")]
    pick = lambda df: df.select(*(F.col(n).cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in names))
    return pick(signals).unionByName(pick(bars))


def grade_stream(rows: DataFrame, window_ms: int = DAY_WINDOW_MS, min_points: float = 0.0) -> DataFrame:
    """Outcomes of streaming feed() rows, one a signal, when a bar decides it or shows its window over.

    The rules are those of the batch grading: a signal's own bar counts, the stop wins a bar that
    touches both. Rows of a batch are taken in order of time, a signal before the bar of its time;
    bars are expected no later than the batch after their signal's. What is open lies in the
    query's checkpoint, so a restart goes on where it stopped, and is bounded by the window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        batch = pd.concat(frames)
        batch = batch.assign(bar=batch["sid"].isna()).sort_values(["ts_ms", "bar"], kind="stable")
        done = []
        for r in batch.itertuples(index=False):
            if not r.bar:
                way = 1 if r.action == "BUY" else -1
                goal = way * max(way * r.target, way * r.entry + min_points)
                held.append({"sid": r.sid, "from": int(r.ts_ms), "way": way, "entry": r.entry, "goal": goal, "stop": r.stop, "up": 0.0, "down": 0.0, "at": int(r.ts_ms), "last": r.entry})
                continue
            still = []
            for s in held:
                if r.ts_ms > s["from"] + window_ms:
                    done.append((key[0], s["sid"], "expired", s["last"], s["at"], s["up"], s["down"]))
                    continue
                if r.ts_ms >= s["from"]:
                    best, worst = (r.h, r.l) if s["way"] > 0 else (r.l, r.h)
                    s["up"], s["down"] = max(s["up"], s["way"] * (best - s["entry"])), min(s["down"], s["way"] * (worst - s["entry"]))
                    s["at"], s["last"] = int(r.ts_ms), r.c
                    status = "stop" if s["way"] * (worst - s["stop"]) <= 0 else "target" if s["way"] * (best - s["goal"]) >= 0 else None
                    if status:
                        done.append((key[0], s["sid"], status, s["stop" if status == "stop" else "goal"], s["at"], s["up"], s["down"]))
                        continue
                still.append(s)
            held = still
        state.update((json.dumps(held),))
        yield pd.DataFrame(done, columns=[x.split()[0] for x in OUT.split(", ")])

    clean = rows.where("symbol is not null and ts_ms is not null")
    return clean.groupBy("symbol").applyInPandasWithState(step, OUT, "open string", "append", GroupStateTimeout.NoTimeout)
