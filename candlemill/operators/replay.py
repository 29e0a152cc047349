"""Rules that must walk a series in order: a ratcheting band, and trades that hold the only slot of a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.market import SQUARE_OFF, day_minutes
from candlemill.functions.scan import ema
from candlemill.operators.indicators import last, of_day
from candlemill.operators.setups import grid
from candlemill.operators.structure import running_vwap


class _Band:
    """Supertrend of one series, bar by bar; it holds a handful of numbers."""

    def __init__(self, period: int, width: float):
        self.period, self.width = period, width
        self.n, self.atr, self.upper, self.lower, self.rising, self.before = -1, 0.0, 0.0, 0.0, True, 0.0

    def add(self, h: float, low: float, c: float) -> tuple[float, bool] | None:
        self.n += 1
        before, self.before = self.before, c
        if not self.n:
            return None
        true = max(h - low, abs(h - before), abs(low - before))
        if self.n <= self.period:
            self.atr += true / self.period
        else:
            self.atr += (true - self.atr) / self.period
        if self.n < self.period:
            return None
        mid, first = (h + low) / 2, self.n == self.period
        top, bottom = mid + self.width * self.atr, mid - self.width * self.atr
        self.upper = top if first or before > self.upper else min(top, self.upper)
        self.lower = bottom if first or before < self.lower else max(bottom, self.lower)
        if first:
            self.rising = c >= mid
        else:
            self.rising = c >= self.lower if self.rising else c > self.upper
        return (self.lower if self.rising else self.upper), self.rising


def supertrend(bars: DataFrame, period: int = 10, width: float = 3.0) -> DataFrame:
    """(symbol, ts_ms, value, rising) from a series' bar after the first period on.

    The band depends on all before it, so a series is walked in one task; it streams through in
    order and is never held whole.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, band = object(), None
        for f in frames:
            out = []
            for s, at, h, low, c in zip(f["symbol"], f["ts_ms"].tolist(), f["h"].tolist(), f["l"].tolist(), f["c"].tolist()):
                if s != symbol:
                    symbol, band = s, _Band(period, width)
                said = band.add(h, low, c)
                if said:
                    out.append((s, at, *said))
            yield pd.DataFrame(out, columns=["symbol", "ts_ms", "value", "rising"])

    own = bars.select("symbol", "ts_ms", "h", "l", "c").repartition("symbol").sortWithinPartitions("symbol", "ts_ms")
    return own.mapInPandas(walk, "symbol string, ts_ms long, value double, rising boolean")


CROSS_TRADE = "symbol string, day int, variant string, ts_ms long, direction string, verdict string, entry double, target double, stop double, entry_ms long, exit_ms long, exit double, status string"


def cross_trades(bars: DataFrame, variants: DataFrame, period: int = 9, look: int = 20, warmup: int = 3, cutoff: int = 900, least_bars: int = 40) -> DataFrame:
    """One row a cross of the average with the session's price and variant(variant, sides, stop_pts, min_rr).

    Verdict is taken, or why not: open (the slot is held, also by a trade that ends on this bar),
    side, time (after the cutoff, or no bar left to fill on), level (the target lies behind the
    entry) or reward. A trade fills at the next bar's open, targets the extreme of the last bars
    across sessions, and ends at the stop before the target, at square-off or with the session.
    Sessions with a bar without volume, or with few bars, are left out. A session, at most a day of
    bars, is one group and goes through the variants inside its task.
    """
    b = running_vwap(ema(bars, "c", period, "ema"))
    b = b.withColumns({"low": F.min("l").over(last(look)), "high": F.max("h").over(last(look)), "k": F.row_number().over(of_day()) - 1})
    e, v = F.lag("ema").over(of_day()), F.lag("vwap").over(of_day())
    side = F.when((e < v) & (F.col("ema") >= F.col("vwap")), 1).when((e > v) & (F.col("ema") <= F.col("vwap")), -1).otherwise(0)
    whole = Window.partitionBy("symbol", "day")
    b = b.withColumns({"side": F.when(F.col("k") >= warmup, side).otherwise(0), "minutes": day_minutes(F.col("ts_ms"))})
    b = b.withColumns({"bars": F.count("*").over(whole), "thin": F.min(F.coalesce("v", F.lit(0.0))).over(whole)}).where((F.col("bars") >= least_bars) & (F.col("thin") > 0))
    b = b.select("symbol", "day", "ts_ms", "o", "h", "l", "c", "low", "high", "side", "minutes")
    given = [(v.variant, v.sides, float(v.stop_pts), float(v.min_rr)) for v in grid(variants).itertuples(index=False)]

    def session(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("ts_ms")
        return pd.DataFrame([r for v in given for r in trades((*key, v[0]), s, *v[1:])], columns=[x.split()[0] for x in CROSS_TRADE.split(", ")]).astype({"entry_ms": "Int64", "exit_ms": "Int64"})

    def trades(key: tuple, s: pd.DataFrame, sides: str, stop_pts: float, min_rr: float) -> list:
        at, o, h, low, c, lo, hi, cross, minutes = (s[x].to_numpy() for x in ("ts_ms", "o", "h", "l", "c", "low", "high", "side", "minutes"))
        n, busy, out = len(s), -1, []
        for i in np.flatnonzero(cross).tolist():
            way = int(cross[i])
            name = "LONG" if way > 0 else "SHORT"
            row = [key[0], key[1], key[2], at[i], name]
            entry = o[i + 1] if i + 1 < n else None
            target = hi[i] if way > 0 else lo[i]
            if i <= busy:
                verdict = "open"
            elif sides not in ("both", name):
                verdict = "side"
            elif minutes[i] >= cutoff or entry is None:
                verdict = "time"
            elif (target - entry) * way <= 0:
                verdict = "level"
            elif abs(target - entry) < stop_pts * min_rr:
                verdict = "reward"
            else:
                verdict = "taken"
            if verdict != "taken":
                out.append([*row, verdict, *[None] * 7])
                continue
            stop = entry - way * stop_pts
            later = slice(i + 1, n)
            stopped = low[later] <= stop if way > 0 else h[later] >= stop
            reached = h[later] >= target if way > 0 else low[later] <= target
            ended = np.flatnonzero(stopped | reached | (minutes[later] >= SQUARE_OFF))
            j = int(ended[0]) if len(ended) else n - i - 2
            status = "stop" if stopped[j] else "target" if reached[j] else "squareoff"
            busy = i + 1 + j
            out.append([*row, verdict, entry, target, stop, at[i + 1], at[busy], {"stop": stop, "target": target}.get(status, c[busy]), status])
        return out

    return b.groupBy("symbol", "day").applyInPandas(session, CROSS_TRADE)
