"""Setups as table functions of SQL: each is given the rows of one partition, a session or a series, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from candlemill.operators.replay import _Band
from candlemill.operators.setups import VARIANT, _Day, _walk

SESSION = ("ts_ms", "o", "h", "l", "c", "minutes", "swing_high", "swing_low", "old_hi", "old_lo", "old_lc")
EVENTS = "symbol string, day int, ts_ms bigint, event string, direction string, pool string, depth double, kind string, entry double, stop double, target double, exit double, status string"


class SweepSetup:
    """Events of the sweep setup of the session that its rows are; one of odd rows gives none."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.key: tuple = ()

    def eval(self, row: Row) -> None:
        self.key = (row["symbol"], row["day"])
        self.rows.append(tuple(row[c] for c in SESSION))

    def terminate(self) -> Iterator[tuple]:
        rows = [r for r in self.rows if None not in r[:5] and None not in r[8:]]
        if rows:
            day = _Day(pd.DataFrame(rows, columns=list(SESSION)).sort_values("ts_ms"), 2)
            v = pd.Series(VARIANT)
            for e in _walk(day, v):
                yield (*self.key, int(day.at[e[0]]), e[1], "LONG" if e[2] > 0 else "SHORT", *(x.item() if hasattr(x, "item") else x for x in e[3:]))


class SupertrendRows:
    """Value and trend of each bar of a series in order of time."""

    def __init__(self):
        self.band = _Band(10, 3.0)

    def eval(self, row: Row) -> Iterator[tuple]:
        said = self.band.add(row["h"], row["l"], row["c"]) if None not in (row["h"], row["l"], row["c"]) else None
        if said:
            yield row["symbol"], int(row["ts_ms"]), float(said[0]), bool(said[1])


def register(spark: SparkSession) -> None:
    """Makes sweep_setup and supertrend known to SQL:

    SELECT * FROM sweep_setup(TABLE(sessions) PARTITION BY (symbol, day) ORDER BY ts_ms) over rows of setups.with_sessions(),
    SELECT * FROM supertrend(TABLE(bars) PARTITION BY symbol ORDER BY ts_ms) over bars.
    """
    spark.udtf.register("sweep_setup", udtf(SweepSetup, returnType=EVENTS))
    spark.udtf.register("supertrend", udtf(SupertrendRows, returnType="symbol string, ts_ms bigint, value double, rising boolean"))
