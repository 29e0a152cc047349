"""Liquidity pools, sweeps of them, and crosses of the average with the session's price."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.scan import ema
from candlemill.operators.indicators import gap_zones, of_day, session_day, swings


def running_vwap(bars: DataFrame) -> DataFrame:
    """Adds vwap (null until volume trades in the day) and chart_vwap (the mean typical price until then)."""
    b = bars.withColumn("day", session_day(F.col("ts_ms")))
    upto, typical = of_day().rowsBetween(Window.unboundedPreceding, 0), (F.col("h") + F.col("l") + F.col("c")) / 3
    volume = F.sum(F.coalesce("v", F.lit(0.0))).over(upto)
    vwap = F.when(volume > 0, F.sum(typical * F.coalesce("v", F.lit(0.0))).over(upto) / volume)
    return b.withColumns({"vwap": vwap, "chart_vwap": F.coalesce(vwap, F.avg(typical).over(upto))})


def pools(bars: DataFrame, span: int = 2) -> DataFrame:
    """(symbol, day, side, price, kind, ord, k, known): yesterday's high, low and close, and the day's swings from the bar that confirms them."""
    b = swings(bars, span).withColumn("k", F.row_number().over(of_day()))
    days = b.groupBy("symbol", "day").agg(F.max("h").alias("hi"), F.min("l").alias("lo"), F.max_by("c", "ts_ms").alias("lc"))
    w = Window.partitionBy("symbol").orderBy("day")
    before = days.select("symbol", "day", *(F.lag(c).over(w).alias(c) for c in ("hi", "lo", "lc"))).where("hi is not null")
    row = lambda side, price, kind, n, k, known: F.struct(F.lit(side).alias("side"), F.col(price).alias("price"), F.lit(kind).alias("kind"), F.lit(n).alias("ord"), k.alias("k"), known.alias("known"))
    zero = F.lit(0)
    old = [row("buy", "hi", "previous high", 0, zero, zero), row("sell", "lo", "previous low", 1, zero, zero), row("buy", "lc", "previous close", 2, zero, zero), row("sell", "lc", "previous close", 3, zero, zero)]
    k = F.col("k")
    new = [F.when(F.col("swing_high"), row("buy", "h", "session high", 4, k, k + span)), F.when(F.col("swing_low"), row("sell", "l", "session low", 5, k, k + span))]
    inherited = before.select("symbol", "day", F.explode(F.array(*old)).alias("p"))
    own = b.where("swing_high or swing_low").select("symbol", "day", F.explode(F.filter(F.array(*new), lambda x: x.isNotNull())).alias("p"))
    return inherited.unionByName(own).select("symbol", "day", "p.*")


def sweeps(bars: DataFrame, span: int = 2, least: float = 0.0) -> DataFrame:
    """(symbol, ts_ms, side, price, kind, depth): bars that trade through a known pool and close back, with the deepest pool taken.

    Bars meet pools of their own (symbol, day), so a group holds one session.
    """
    b = bars.withColumn("day", session_day(F.col("ts_ms"))).withColumn("bar", F.row_number().over(of_day()))
    p = pools(bars, span)
    taken = F.when(F.col("side") == "buy", (F.col("h") > F.col("price")) & (F.col("c") < F.col("price"))).otherwise((F.col("l") < F.col("price")) & (F.col("c") > F.col("price")))
    depth = F.when(F.col("side") == "buy", F.col("h") - F.col("price")).otherwise(F.col("price") - F.col("l"))
    met = b.select("symbol", "day", "ts_ms", "bar", "h", "l", "c").join(p, ["symbol", "day"]).where((F.col("bar") >= F.col("known")) & taken).withColumn("depth", depth).where(F.col("depth") >= least)
    deepest = F.max(F.struct("depth", (-F.col("ord")).alias("o"), (-F.col("k")).alias("i"), "side", "price", "kind")).alias("x")
    return met.groupBy("symbol", "ts_ms").agg(deepest).select("symbol", "ts_ms", "x.side", "x.price", "x.kind", "x.depth")


def crosses(bars: DataFrame, period: int = 20) -> DataFrame:
    """(symbol, ts_ms, direction, ema, vwap) where the average changes sides of the session's price; a touch counts, a session's first bar never."""
    b = running_vwap(ema(bars, "c", period, "ema"))
    e, v = F.lag("ema").over(of_day()), F.lag("vwap").over(of_day())
    side = F.when((e < v) & (F.col("ema") >= F.col("vwap")), "LONG").when((e > v) & (F.col("ema") <= F.col("vwap")), "SHORT")
    return b.withColumn("direction", side).where("direction is not null").select("symbol", "ts_ms", "direction", "ema", "vwap")


def breaks(bars: DataFrame, span: int = 2, lookback: int = 10) -> DataFrame:
    """(symbol, ts_ms, direction, level, kind, block_low, block_high, protect, gap): closes beyond the swing that stood before the bar.

    The level is the last confirmed swing of the day, else the day's extreme so far. A break
    against the run of the last two swings of the other side changes character (CHoCH), any other
    is one of structure (BOS). The block is the last opposing candle within lookback bars, protect
    the extreme of it and the span bars before, gap the height of the largest imbalance there; they
    are null where there is none. A break needs a bar before it in its day.
    """
    w = of_day()
    before, own = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-span, 0)
    b = swings(bars, span)
    b = b.withColumns({"hi": F.when(F.col("swing_high"), F.col("h")), "lo": F.when(F.col("swing_low"), F.col("l"))})
    rose, fell = F.col("hi") > F.last("hi", ignorenulls=True).over(before), F.col("lo") < F.last("lo", ignorenulls=True).over(before)
    near, far = F.lag("l").over(w) - F.lead("h").over(w), F.lead("l").over(w) - F.lag("h").over(w)
    b = b.withColumns({"rose": F.when(F.col("hi").isNotNull(), F.coalesce(rose, F.lit(False))), "fell": F.when(F.col("lo").isNotNull(), F.coalesce(fell, F.lit(False))), "k": F.row_number().over(w)})
    b = b.withColumns({"drop": F.when(near > 0, near), "jump": F.when(far > 0, far), "top": F.max("h").over(own), "bottom": F.min("l").over(own)})
    # a swing is known span bars after it, and a bar is held against what was known at the bar before
    known = w.rowsBetween(Window.unboundedPreceding, -1 - span)
    leg = w.rowsBetween(-lookback, -1)
    rising = F.col("c") >= F.col("o")
    block = lambda side, edge: F.max(F.when(side, F.struct("k", "l", "h", F.col(edge).alias("edge")))).over(leg)
    b = b.withColumns(
        {
            "low_level": F.coalesce(F.last("lo", ignorenulls=True).over(known), F.min("l").over(before)),
            "high_level": F.coalesce(F.last("hi", ignorenulls=True).over(known), F.max("h").over(before)),
            "was_rising": F.coalesce(F.last("rose", ignorenulls=True).over(known), F.lit(False)),
            "was_falling": F.coalesce(F.last("fell", ignorenulls=True).over(known), F.lit(False)),
            "up_block": block(rising, "top"), "down_block": block(~rising, "bottom"), "most_drop": F.max("drop").over(leg), "most_jump": F.max("jump").over(leg),
        }
    )
    kind = lambda change: F.when(F.col(change), "CHoCH").otherwise("BOS").alias("kind")
    row = lambda d, level, change, at, gap: F.struct(F.lit(d).alias("direction"), F.col(level).alias("level"), kind(change), F.col(f"{at}.l").alias("block_low"), F.col(f"{at}.h").alias("block_high"), F.col(f"{at}.edge").alias("protect"), F.col(gap).alias("gap"))
    said = F.array(F.when(F.col("c") < F.col("low_level"), row("SHORT", "low_level", "was_rising", "up_block", "most_drop")), F.when(F.col("c") > F.col("high_level"), row("LONG", "high_level", "was_falling", "down_block", "most_jump")))
    return b.select("symbol", "ts_ms", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x")).select("symbol", "ts_ms", "x.*")


def zone_signals(bars: DataFrame, reach: int = 80, most: int = 8) -> DataFrame:
    """(symbol, n, type, status, low, high): what the gap zones say at each bar.

    Of the zones formed within reach the newest few count, then those already filled go. The close
    inside a bullish zone, else a bearish one, calls for its side; else the newest zone does.
    """
    zones = gap_zones(bars, reach=reach)
    b = bars.select("symbol", "c", F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ms")).alias("n")).withColumn("block", F.floor(F.col("n") / reach))
    z = zones.withColumnRenamed("n", "mid").withColumn("block", F.explode(F.sequence(F.floor((F.col("mid") + 1) / reach), F.floor((F.col("mid") + reach - 1) / reach))))
    met = b.join(z, ["symbol", "block"]).where((F.col("n") > F.col("mid")) & (F.col("n") < F.col("mid") + reach))
    met = met.withColumn("k", F.row_number().over(Window.partitionBy("symbol", "n").orderBy(F.desc("mid")))).where(F.col("k") <= most)
    fresh = met.where(F.col("filled_n").isNull() | (F.col("filled_n") > F.col("n")))
    inside = F.col("c").between(F.col("low"), F.col("high"))
    zone = F.struct("mid", "side", "low", "high")
    g = fresh.groupBy("symbol", "n").agg(F.max(F.when(inside & (F.col("side") == "bull"), zone)).alias("x"), F.max(F.when(inside & (F.col("side") == "bear"), zone)).alias("y"), F.max(zone).alias("z"))
    g = g.withColumn("status", F.when(F.coalesce("x", "y").isNull(), "formed").otherwise("inside")).withColumn("q", F.coalesce("x", "y", "z"))
    return g.select("symbol", "n", F.when(F.col("q.side") == "bull", "BUY").otherwise("SELL").alias("type"), "status", "q.low", "q.high")


def cross_reading(bars: DataFrame, period: int = 9, look: int = 20, stop_pts: float = 20.5, min_rr: float = 1.5) -> DataFrame:
    """(symbol, day, ts_ms, side, cross_ms, entry, target, stop, rr, passes): where each series stands at its newest bar.

    side is that of the average against the session's price, cross_ms the session's last cross, null
    for none. The target is the extreme of the last bars on that side; a target behind the entry has
    no rr and does not pass. A session without volume so far has no side.
    """
    upto = Window.partitionBy("symbol").orderBy("ts_ms").rowsBetween(1 - look, 0)
    b = running_vwap(ema(bars, "c", period, "ema")).withColumns({"lo": F.min("l").over(upto), "hi": F.max("h").over(upto)})
    newest = b.groupBy("symbol").agg(F.max_by(F.struct("day", "ts_ms", "c", "ema", "vwap", "lo", "hi"), "ts_ms").alias("x")).select("symbol", "x.*")
    newest = newest.withColumn("side", F.when(F.col("ema") >= F.col("vwap"), "LONG").when(F.col("ema") < F.col("vwap"), "SHORT"))
    seen = crosses(bars, period).withColumn("day", session_day(F.col("ts_ms"))).groupBy("symbol", "day").agg(F.max("ts_ms").alias("cross_ms"))
    way = F.when(F.col("side") == "LONG", 1).when(F.col("side") == "SHORT", -1)
    n = newest.join(seen, ["symbol", "day"], "left").withColumn("target", F.when(way == 1, F.col("hi")).when(way == -1, F.col("lo")))
    reward = (F.col("target") - F.col("c")) * way
    n = n.withColumns({"stop": F.col("c") - way * stop_pts, "rr": F.when(reward > 0, reward / stop_pts)})
    return n.select("symbol", "day", "ts_ms", "side", "cross_ms", F.col("c").alias("entry"), "target", "stop", "rr", F.coalesce(F.col("rr") >= min_rr, F.lit(False)).alias("passes"))
