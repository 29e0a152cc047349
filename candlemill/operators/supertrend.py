"""Supertrend in chunks of a series, equal to a walk over all of it.

What a bar does to the band is a small map of what it was before: the average range is an affine map, the
upper band becomes top below the last close and else the less of both, the lower band mirrors that, and
the trend is a map of two states once the bands are known. A chunk's maps are put together on their own,
a series' chunks, not its bars, are then gone through in order to find what enters each, and the chunk
is worked out from there. A task holds one chunk or one row a chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.market import DAY_MS
from candlemill.operators.replay import _Band
from candlemill.sources.shared import written

CHUNK_MS = 16 * DAY_MS


class Pieces:
    """A map of a number by pieces, from `at` on each: a constant, or the number itself (nan)."""

    def __init__(self, at=(-np.inf,), to=(np.nan,)):
        self.at, self.to = np.array(at, float), np.array(to, float)

    def then(self, close: float, top: float) -> None:
        """Go on to top where the value lies below close, and to the less of both elsewhere."""
        at, to = self.at, self.to
        step = np.where(to < close, top, np.minimum(to, top))
        own = np.flatnonzero(np.isnan(to))
        if len(own):  # there is one such piece at most
            k = int(own[0])
            a, b = at[k], at[k + 1] if k + 1 < len(at) else np.inf
            parts = [(a, min(b, close), top), (max(a, close), min(b, top), np.nan), (max(a, close, top), b, top)]
            parts = [(x, v) for x, y, v in parts if x < y]
            at = np.r_[at[:k], [x for x, _ in parts], at[k + 1 :]]
            step = np.r_[step[:k], [v for _, v in parts], step[k + 1 :]]
        keep = np.r_[True, ~((step[1:] == step[:-1]) | (np.isnan(step[1:]) & np.isnan(step[:-1])))]
        self.at, self.to = at[keep], step[keep]

    def of(self, value: float) -> float:
        v = self.to[np.searchsorted(self.at, value, side="right") - 1]
        return value if np.isnan(v) else float(v)


def _start(bars: DataFrame, period: int, width: float) -> DataFrame:
    """(symbol, start_ms, atr, upper, lower, rising, c) of each series after its first period, from its first bars alone."""
    first = bars.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ms"))).where(F.col("k") <= period + 1)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        band, said = _Band(period, width), None
        for h, low, c in f.sort_values("ts_ms")[["h", "l", "c"]].itertuples(index=False):
            said = band.add(h, low, c)
        rows = [(*key, int(f["ts_ms"].max()), band.atr, band.upper, band.lower, bool(band.rising), band.before)] if said else []
        return pd.DataFrame(rows, columns=["symbol", "start_ms", "atr", "upper", "lower", "rising", "c"])

    return first.groupBy("symbol").applyInPandas(run, "symbol string, start_ms long, atr double, upper double, lower double, rising boolean, c double")


def _entering(chunks: DataFrame, start: DataFrame, columns: str, step) -> DataFrame:
    """(symbol, chunk, columns): what enters each chunk of a series, from its start and step(values, chunk's row) through the ones before."""
    names = [c.split()[0] for c in columns.split(", ")]
    given = chunks.join(start.select("symbol", *(F.col(n).alias(f"start_{n}") for n in names)), "symbol")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows, now = [], None
        for r in f.sort_values("chunk").itertuples(index=False):
            now = tuple(getattr(r, f"start_{n}") for n in names) if now is None else now
            rows.append((key[0], r.chunk, *now))
            now = step(now, r)
        return pd.DataFrame(rows, columns=["symbol", "chunk", *names])

    return given.groupBy("symbol").applyInPandas(run, f"symbol string, chunk long, {columns}")


def _bands(f: pd.DataFrame, period: int, width: float):
    """Times, closes before, highs' and lows' bands of a chunk's bars in order, by the average range and close that enter."""
    f = f.sort_values("ts_ms")
    h, low, c = (f[x].to_numpy(float) for x in ("h", "l", "c"))
    before = np.r_[float(f["in_c"].iloc[0]), c[:-1]]
    true = np.maximum(h - low, np.maximum(np.abs(h - before), np.abs(low - before)))
    atr, now = np.empty(len(c)), float(f["in_atr"].iloc[0])
    for k, t in enumerate(true):
        now += (t - now) / period
        atr[k] = now
    mid = (h + low) / 2
    return f["ts_ms"].to_numpy(), c, before, mid + width * atr, mid - width * atr


def supertrend(bars: DataFrame, period: int = 10, width: float = 3.0, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """(symbol, ts_ms, value, rising) from a series' bar after the first period on: the rows of replay.supertrend."""
    own = bars.select("symbol", "ts_ms", "h", "l", "c")
    start = written(_start(own, period, width), "starts")
    rest = own.join(F.broadcast(start.select("symbol", "start_ms")), "symbol").where("ts_ms > start_ms").drop("start_ms").withColumn("chunk", F.floor(F.col("ts_ms") / chunk_ms))
    ends = rest.groupBy("symbol", "chunk").agg(F.max_by("c", "ts_ms").alias("last_c"))
    closes = _entering(ends, start, "c double", lambda now, r: (r.last_c,)).withColumnRenamed("c", "in_c")
    rest = rest.join(closes, ["symbol", "chunk"])

    def ranges(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ts_ms")
        h, low, c = (f[x].to_numpy(float) for x in ("h", "l", "c"))
        before, own = np.r_[float(f["in_c"].iloc[0]), c[:-1]], 0.0
        for t in np.maximum(h - low, np.maximum(np.abs(h - before), np.abs(low - before))):
            own += (t - own) / period
        return pd.DataFrame([(*key, (1 - 1 / period) ** len(c), own)], columns=["symbol", "chunk", "a", "b"])

    affine = rest.groupBy("symbol", "chunk").applyInPandas(ranges, "symbol string, chunk long, a double, b double")
    atrs = _entering(affine, start, "atr double", lambda now, r: (now[0] * r.a + r.b,)).withColumnRenamed("atr", "in_atr")
    rest = rest.join(atrs, ["symbol", "chunk"])

    def maps(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        _, _, before, top, bottom = _bands(f, period, width)
        up, down = Pieces(), Pieces()
        for b, t, low in zip(before, top, bottom):
            up.then(b, t)
            down.then(-b, -low)  # the lower band is the upper one of the mirrored prices
        return pd.DataFrame([(*key, up.at, up.to, down.at, down.to)], columns=["symbol", "chunk", "up_at", "up_to", "down_at", "down_to"])

    pieces = rest.groupBy("symbol", "chunk").applyInPandas(maps, "symbol string, chunk long, up_at array<double>, up_to array<double>, down_at array<double>, down_to array<double>")
    through = lambda now, r: (Pieces(r.up_at, r.up_to).of(now[0]), -Pieces(r.down_at, r.down_to).of(-now[1]))
    bands = _entering(pieces, start, "upper double, lower double", through)
    rest = rest.join(bands, ["symbol", "chunk"])

    def trends(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        at, c, before, top, bottom = _bands(f, period, width)
        upper, lower, ways, rows = float(f["upper"].iloc[0]), float(f["lower"].iloc[0]), [True, False], []
        for k in range(len(c)):
            upper = top[k] if before[k] > upper else min(top[k], upper)
            lower = bottom[k] if before[k] < lower else max(bottom[k], lower)
            ways = [bool(c[k] >= lower if w else c[k] > upper) for w in ways]
            rows.append((*key, int(at[k]), upper, lower, *ways))
        return pd.DataFrame(rows, columns=["symbol", "chunk", "ts_ms", "upper", "lower", "up", "down"])

    both = rest.groupBy("symbol", "chunk").applyInPandas(trends, "symbol string, chunk long, ts_ms long, upper double, lower double, up boolean, down boolean")
    both = written(both, "bands")
    turned = both.groupBy("symbol", "chunk").agg(F.max_by("up", "ts_ms").alias("up"), F.max_by("down", "ts_ms").alias("down"))
    rising = _entering(turned, start, "rising boolean", lambda now, r: (bool(r.up if now[0] else r.down),))
    out = both.join(rising, ["symbol", "chunk"]).withColumn("rising", F.when(F.col("rising"), F.col("up")).otherwise(F.col("down")))
    out = out.select("symbol", "ts_ms", "upper", "lower", "rising").unionByName(start.select("symbol", F.col("start_ms").alias("ts_ms"), "upper", "lower", "rising"))
    return out.select("symbol", "ts_ms", F.when(F.col("rising"), F.col("lower")).otherwise(F.col("upper")).alias("value"), "rising")
