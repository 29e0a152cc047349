"""Turning readings into signals, and merging repeats of one signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 20 * 60_000


def band_signals(bars: DataFrame, profit: float = 1.5, stop: float = 0.8) -> DataFrame:
    """Readings where RSI or the Bollinger band calls: BUY first, then SELL; levels in percent of the close."""
    buy = (F.col("rsi") < 35) | ((F.col("bb_lower") > 0) & (F.col("c") <= F.col("bb_lower") * 1.002))
    sell = (F.col("rsi") > 65) | ((F.col("bb_upper") > 0) & (F.col("c") >= F.col("bb_upper") * 0.998))
    s = bars.withColumn("action", F.when(buy, "BUY").when(sell, "SELL")).where("action is not null")
    sign = F.when(F.col("action") == "BUY", 1).otherwise(-1)
    return s.select(
        "symbol", "ts_ms", "action", F.col("c").alias("entry"), (F.col("c") * (1 + sign * profit / 100)).alias("target"),
        (F.col("c") * (1 - sign * stop / 100)).alias("stop"), F.abs(F.col("rsi") - 50).alias("confidence"),
    )


def merge_signals(readings: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Merged log of readings(symbol, ts_ms, action, confidence, entry, target, stop).

    A reading is appended if its action is new or the last stored reading lies more than gap_ms
    back; it updates the last entry if its confidence differs; else it is skipped and does not
    move the stored time. An entry keeps the id and first time of its first reading, the values of
    its last update, the peak confidence and the count.

    What is skipped equals the stored confidence, so a reading whose confidence differs from its
    neighbour's is always stored, and only runs of one confidence have to be walked from reading to
    reading. All steps keep the partitioning by symbol: one shuffle. Readings of one time keep the
    order that the first sort gave them.
    """
    w = Window.partitionBy("symbol").orderBy("ts_ms")
    before = lambda c: F.lag(c).over(w)
    cut = before("ts_ms").isNull() | (before("action") != F.col("action")) | (F.col("ts_ms") - before("ts_ms") > gap_ms)
    r = readings.withColumns({"place": F.row_number().over(w), "cut": cut, "turn": cut | (before("confidence") != F.col("confidence"))})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumns({"island": F.sum(F.col("cut").cast("int")).over(so_far), "run": F.sum(F.col("turn").cast("int")).over(so_far)})
    row = F.struct("place", "ts_ms", "confidence", "entry", "target", "stop")
    runs = r.groupBy("symbol", "run").agg(F.first("action").alias("action"), F.first("island").alias("island"), F.array_sort(F.collect_list(row)).alias("rows"))
    later = F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    kept = F.aggregate(later, F.slice("rows", 1, 1), lambda log, x: F.when(x["ts_ms"] - F.element_at(log, -1)["ts_ms"] > gap_ms, F.concat(log, F.array(x))).otherwise(log))
    stored = runs.select("symbol", "action", "island", F.explode(kept).alias("x")).select("symbol", "action", "island", "x.*")
    placed = Window.partitionBy("symbol").orderBy("place")
    last = lambda c: F.lag(c).over(placed)
    new = last("ts_ms").isNull() | (last("island") != F.col("island")) | (F.col("ts_ms") - last("ts_ms") > gap_ms)
    stored = stored.withColumn("new", new).withColumn("id", F.sum(F.col("new").cast("int")).over(placed))
    newest = lambda c: F.max_by(c, "place").alias(c)
    log = stored.groupBy("symbol", "action", "id").agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("at"), F.count("*").cast("int").alias("updates"), newest("confidence"), F.max("confidence").alias("peak"), newest("entry"), newest("target"), newest("stop"),
    )
    return log.select("symbol", "action", "first_ms", F.col("at").alias("ts_ms"), "updates", "confidence", "peak", "entry", "target", "stop")
