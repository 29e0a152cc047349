"""Keyed state that follows event time: rows wait for the watermark, are taken in order, and times of their own come due without a row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A time after all others: a batch's watermark.
NEVER = 1 << 60


def use_timers(spark: SparkSession) -> None:
    """Take the state store that timers and map state need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Follower:
    """What a key remembers. A subclass says what a row and a time that comes due give, and what it keeps.

    row(r) and due(t) return output rows without the key; next_time() is the earliest time at which
    something happens without a row, or None; state() is a plain value, None when nothing is left
    to remember, which frees the key.
    """

    def __init__(self, state):
        raise NotImplementedError


class Ordered(StatefulProcessor):
    """Feeds a Follower with a key's rows in order of time and with its due times between them.

    Rows wait in map state, by time, until the watermark has passed them, so what comes out does not hang on
    how rows arrive or are batched, as long as none is later than the watermark's delay; Spark drops
    those. One timer a key stands at whatever is next.
    """

    def __init__(self, follower: Callable, columns: list[str], out: list[str], rank: Callable[[tuple], object]):
        self.follower, self.columns, self.out, self.rank = follower, columns, out, rank

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts_ms long", "rows string")
        self.kept = handle.getValueState("kept", "value string, timer long")

    def _kept(self) -> tuple:
        if not self.kept.exists():
            return None, None
        value, timer = self.kept.get()
        return (json.loads(value) if value is not None else None), timer

    def _set(self, value, old_timer, new_timer) -> None:
        if old_timer is not None and old_timer != new_timer:
            self.handle.deleteTimer(old_timer)
        if new_timer is not None and old_timer != new_timer:
            self.handle.registerTimer(new_timer)
        if value is None and new_timer is None:
            self.kept.clear()
        else:
            self.kept.update((json.dumps(value) if value is not None else None, new_timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, timer = self._kept()
        new: dict[int, list] = {}
        for part in rows:
            for r in part[self.columns].astype(object).where(part[self.columns].notna(), None).itertuples(index=False, name=None):
                new.setdefault(int(r[0]), []).append([x.item() if hasattr(x, "item") else x for x in r])
        for at, own in new.items():
            if self.waiting.containsKey((at,)):
                own = json.loads(self.waiting.getValue((at,))[0]) + own
            self.waiting.updateValue((at,), (json.dumps(own),))
        first = min(new, default=None)
        self._set(value, timer, first if timer is None else timer if first is None else min(timer, first))
        yield pd.DataFrame([], columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, timer = self._kept()
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        follower, said = self.follower(value), []
        times = sorted(k[0] for k in self.waiting.keys())
        passed = [t for t in times if t <= mark]
        for at in passed:
            said += self._come_due(follower, at - 1)
            own = [tuple(r) for r in json.loads(self.waiting.getValue((at,))[0])]
            for r in sorted(own, key=self.rank):
                said += follower.row(r)
            self.waiting.removeKey((at,))
        said += self._come_due(follower, mark)
        left = times[len(passed) :]
        ahead = [t for t in (left[0] if left else None, follower.next_time()) if t is not None]
        # the timer that fired is gone
        self._set(follower.state(), None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, min(ahead, default=None))
        yield pd.DataFrame([(*key, *x) for x in said], columns=self.out)

    @staticmethod
    def _come_due(follower, upto: int) -> list:
        said = []
        while (t := follower.next_time()) is not None and t <= upto:
            said += follower.due(t)
        return said

    def close(self) -> None:
        pass


def follow(rows: DataFrame, follower: Callable, columns: str, out: str, rank: Callable[[tuple], object], late: str = "10 minutes") -> DataFrame:
    """Rows of out that followers of each symbol give over rows, streaming or not; columns are the follower's, ts_ms first.

    Rows without symbol or ts_ms are left out. A stream needs use_timers() and gives rows once the
    watermark, which lies late behind the newest row of any symbol, has passed them; what is still
    due after it comes when it moves on. A batch gives everything.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    clean = rows.where("symbol is not null and ts_ms is not null").select("symbol", *(F.col(c.split()[0]).cast(c.split()[1]) for c in columns.split(", ")))
    outs = [c.split()[0] for c in out.split(", ")]
    if not rows.isStreaming:
        return clean.groupBy("symbol").applyInPandas(_whole(follower, names, outs, rank), out)
    timed = clean.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return timed.groupBy("symbol").transformWithStateInPandas(Ordered(follower, names, outs, rank), out, "append", "eventtime")


def _whole(follower: Callable, columns: list[str], out: list[str], rank):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own, said = follower(None), []
        rows = [tuple(r) for r in part[columns].astype(object).where(part[columns].notna(), None).itertuples(index=False, name=None)]
        for r in sorted(rows, key=lambda r: (r[0], rank(r))):
            said += Ordered._come_due(own, r[0] - 1)
            said += own.row(r)
        said += Ordered._come_due(own, NEVER)
        return pd.DataFrame([(*key, *x) for x in said], columns=out)

    return run
