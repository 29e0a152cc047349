"""Grading of signals against the later price path: a bounded range join and the first touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.market import DAY_MS

DAY_WINDOW_MS, HOUR_MS = 86_400_000, 3_600_000


def grade(signals: DataFrame, bars: DataFrame, window_ms: int = DAY_WINDOW_MS, now_ms=None, min_points: float = 0.0) -> DataFrame:
    """signals(sid, symbol, ts_ms, action, entry, target, stop) with status, resolved price and time, MFE and MAE.

    Bars from the signal's own to the window's end count, met by symbol and day. The first bar that
    touches target or stop decides, and the stop where one bar touches both. Nothing touched is
    expired once now_ms lies beyond the window (None: always), at the last close, else pending.
    """
    buy = F.col("action") == "BUY"
    far = F.when(buy, F.greatest("target", F.col("entry") + min_points)).otherwise(F.least("target", F.col("entry") - min_points))
    s = signals.withColumn("goal", far).withColumn("upto", F.col("ts_ms") + window_ms)
    days = F.sequence(F.floor(F.col("ts_ms") / DAY_MS), F.floor(F.col("upto") / DAY_MS))
    b = bars.select("symbol", F.col("ts_ms").alias("at"), "h", "l", "c", F.floor(F.col("ts_ms") / DAY_MS).alias("bucket"))
    met = s.select("sid", "symbol", "ts_ms", "upto", "action", "entry", "goal", "stop", F.explode(days).alias("bucket")).join(b, ["symbol", "bucket"]).where("at between ts_ms and upto")
    hit_goal = F.when(buy, F.col("h") >= F.col("goal")).otherwise(F.col("l") <= F.col("goal"))
    hit_stop = F.when(buy, F.col("l") <= F.col("stop")).otherwise(F.col("h") >= F.col("stop"))
    met = met.withColumns({"g": hit_goal, "x": hit_stop})
    first = F.min(F.when(F.col("g") | F.col("x"), F.col("at"))).over(Window.partitionBy("sid"))
    seen = met.withColumn("first", first).where("first is null or at <= first")
    gain = F.when(buy, F.col("h") - F.col("entry")).otherwise(F.col("entry") - F.col("l"))
    loss = F.when(buy, F.col("l") - F.col("entry")).otherwise(F.col("entry") - F.col("h"))
    path = seen.groupBy("sid").agg(
        F.first("first").alias("first"), F.max_by("x", "at").alias("stopped"), F.max("at").alias("last_at"), F.max_by("c", "at").alias("last_c"),
        F.greatest(F.max(gain), F.lit(0.0)).alias("mfe"), F.least(F.min(loss), F.lit(0.0)).alias("mae"),
    )
    out = s.join(path, "sid", "left")
    over = F.lit(True) if now_ms is None else F.lit(now_ms) - F.col("ts_ms") > window_ms
    status = F.when(F.col("first").isNotNull(), F.when(F.col("stopped"), "stop").otherwise("target")).when(over, "expired").otherwise("pending")
    price = F.when(F.col("status") == "stop", F.col("stop")).when(F.col("status") == "target", F.col("goal")).when(F.col("status") == "expired", F.coalesce("last_c", "entry"))
    when = F.when(F.col("first").isNotNull(), F.col("first")).when(F.col("status") == "expired", F.coalesce("last_at", "ts_ms"))
    out = out.withColumn("status", status).withColumns({"resolved_price": price, "resolved_ms": when, "mfe": F.coalesce("mfe", F.lit(0.0)), "mae": F.coalesce("mae", F.lit(0.0))})
    return out.select(*signals.columns, "status", "resolved_price", "resolved_ms", "mfe", "mae")


def summarize(graded: DataFrame, by: list[str], cost: float = 6.0, count_expired: bool = False) -> DataFrame:
    """Economics of graded signals: win rate, gross and net expectancy, profit factor, drawdown.

    Equity is summed within each hour of a group, and the hours' sums, peaks and lows are then put
    together, so no task holds the trades of a whole group.
    """
    settled = F.col("status").isin("target", "stop", *(["expired"] if count_expired else []))
    sign = F.when(F.col("action") == "BUY", 1.0).otherwise(-1.0)
    t = graded.where(settled).withColumn("gross", (F.col("resolved_price") - F.col("entry")) * sign).withColumn("net", F.col("gross") - cost)
    t = t.withColumn("hour", F.floor(F.col("ts_ms") / HOUR_MS))
    order = Window.partitionBy(*by, "hour").orderBy("ts_ms", "sid").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("equity", F.sum("net").over(order)).withColumn("drop", F.max("equity").over(order) - F.col("equity"))
    win, total = F.col("gross") > 0, F.sum
    hours = t.groupBy(*by, "hour").agg(
        F.count("*").alias("n"), total(win.cast("long")).alias("wins"), total("gross").alias("gross"), total("net").alias("net"), total(F.when(win, F.col("gross"))).alias("up"), total(F.when(~win, F.col("gross"))).alias("down"),
        F.max("equity").alias("peak"), F.min("equity").alias("low"), F.max("drop").alias("drop"),
    )
    past = Window.partitionBy(*by).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("before", F.coalesce(total("net").over(past), F.lit(0.0)))
    peak = F.greatest(F.max(F.col("before") + F.col("peak")).over(past), F.lit(0.0))
    hours = hours.withColumn("drop", F.greatest("drop", peak - F.col("before") - F.col("low")))
    n, up, down = total("n"), F.coalesce(total("up"), F.lit(0.0)), F.abs(total("down"))
    return hours.groupBy(*by).agg(
        n.alias("resolved"),
        F.round(total("wins") / n * 100, 4).alias("win_pct"),
        F.round(total("gross") / n, 4).alias("gross_pts"),
        F.round(total("net") / n, 4).alias("net_pts"),
        F.round(total("net"), 4).alias("total_net"),
        F.round(F.when(down > 0, up / down), 2).alias("profit_factor"),
        F.round(F.max("drop"), 4).alias("max_drawdown"),
    )


def regrade(log: DataFrame, bars: DataFrame, window_ms: int = DAY_WINDOW_MS, now_ms=None, min_points: float = 0.0) -> DataFrame:
    """A graded log with its pending rows graded again and changed set where that altered them; all other rows stay frozen."""
    pending = F.coalesce(F.col("status") == "pending", F.lit(True))
    given = [c for c in log.columns if c not in ("status", "resolved_price", "resolved_ms", "mfe", "mae")]
    before = log.where(pending).select("sid", F.struct("status", "mfe", "mae").alias("was"))
    again = grade(log.where(pending).select(given), bars, window_ms, now_ms, min_points).join(before, "sid")
    again = again.withColumn("changed", ~F.struct("status", "mfe", "mae").eqNullSafe(F.col("was"))).drop("was")
    return log.where(~pending).withColumn("changed", F.lit(False)).unionByName(again)
