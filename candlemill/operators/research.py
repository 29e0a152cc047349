"""Calendar and session effects: every hypothesis is a label on a daily row, tested in one aggregation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.functions.market import percent
from candlemill.functions.options import erfc

LEAST = 30


def hypotheses(daily: DataFrame, gap: float = 0.3, move: float = 1.0, streak: int = 3, years: int = 4) -> DataFrame:
    """(symbol, test, base, value) of daily(symbol, day, o, h, l, c); base names the pooled sample compared with, if any."""
    w = Window.partitionBy("symbol").orderBy("day")
    d = daily.withColumn("pc", F.lag("c").over(w))
    d = d.withColumns({"full": F.when(F.col("pc").isNotNull(), percent(F.col("c"), F.col("pc"))), "night": F.when(F.col("pc").isNotNull(), percent(F.col("o"), F.col("pc"))), "open_close": percent(F.col("c"), F.col("o"))})
    before = w.rowsBetween(-streak, -1)
    d = d.withColumns({"last": F.lag("full").over(w), "k": F.count("full").over(before), "top": F.max("full").over(before), "low": F.min("full").over(before)})
    year = F.year("day")
    bucket = (year - year % years).cast("string")
    known = F.col("pc").isNotNull()
    row = lambda when, test, base, value: F.when(known & when, F.struct(test.alias("test"), F.lit(base).alias("base"), F.col(value).alias("value")))
    yes = F.lit(True)
    side = F.when(F.col("night") >= gap, "gap_up").when(F.col("night") <= -gap, "gap_down").otherwise("gap_none")
    labels = [
        row(yes, F.lit("overnight"), "", "night"), row(F.col("o") != 0, F.lit("intraday"), "", "open_close"), row(yes, F.lit("full_day"), "", "full"),
        row(yes, F.concat(F.lit("overnight_"), bucket), "", "night"), row(yes, side, "all_gaps", "open_close"), row(yes, F.lit("all_gaps"), "", "open_close"),
        row(F.weekday("day") < 5, F.concat(F.lit("weekday_"), F.weekday("day").cast("string")), "full_day", "full"),
        row(yes, F.concat(F.lit("month_"), F.month("day").cast("string")), "full_day", "full"),
        row(F.col("last") <= -move, F.lit("after_down"), "full_day", "full"), row(F.col("last") >= move, F.lit("after_up"), "full_day", "full"),
        row((F.col("k") == streak) & (F.col("top") < 0), F.lit("after_down_streak"), "full_day", "full"),
        row((F.col("k") == streak) & (F.col("low") > 0), F.lit("after_up_streak"), "full_day", "full"),
    ]
    return d.select("symbol", F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())).alias("x")).select("symbol", "x.*")


def findings(samples: DataFrame) -> DataFrame:
    """(symbol, test, n, mean, sd, base_mean, t): whether each test's mean differs from its base, zero without one."""
    s = samples.groupBy("symbol", "test", "base").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    pooled = s.select("symbol", F.col("test").alias("base"), F.col("mean").alias("base_mean"))
    s = s.join(pooled, ["symbol", "base"], "left").withColumn("base_mean", F.coalesce("base_mean", F.lit(0.0)))
    flat = (F.col("n") < 2) | (F.coalesce("sd", F.lit(0.0)) == 0)
    return s.select("symbol", "test", "n", "mean", F.coalesce("sd", F.lit(0.0)).alias("sd"), "base_mean", F.when(flat, 0.0).otherwise((F.col("mean") - F.col("base_mean")) / (F.col("sd") / F.sqrt("n"))).alias("t"))


def with_p_values(found: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds the two-sided p, the Bonferroni bar over all rows, and whether a row with enough cases survives it."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(p=erfc(np.abs(f["t"].to_numpy(dtype=float)) / math.sqrt(2)))

    tested = found.mapInPandas(add, T.StructType([*found.schema, T.StructField("p", T.DoubleType())]))
    bar = found.agg((F.lit(alpha) / F.greatest(F.count("*"), F.lit(1))).alias("bar"))
    return tested.crossJoin(F.broadcast(bar)).withColumn("survives", (F.col("p") < F.col("bar")) & (F.col("n") >= LEAST))


def gap_fills(daily: DataFrame, gap: float = 0.3) -> DataFrame:
    """(symbol, side, n, filled, rate, z): how often a gap trades back to the close before on its day, against one half."""
    d = daily.withColumn("pc", F.lag("c").over(Window.partitionBy("symbol").orderBy("day"))).where("pc is not null")
    night = percent(F.col("o"), F.col("pc"))
    d = d.withColumn("side", F.when(night >= gap, "up").when(night <= -gap, "down")).where("side is not null")
    filled = F.when(F.col("side") == "up", F.col("l") <= F.col("pc")).otherwise(F.col("h") >= F.col("pc"))
    g = d.groupBy("symbol", "side").agg(F.count("*").alias("n"), F.sum(filled.cast("long")).alias("filled"))
    rate = F.col("filled") / F.col("n")
    return g.withColumn("rate", rate).withColumn("z", (rate - 0.5) / F.sqrt(F.lit(0.25) / F.col("n")))


def opening_breakouts(bars: DataFrame, open_bars: int = 3, rest: int = 5) -> DataFrame:
    """(symbol, day, side, ret) of bars with day: the first break of the opening range, up on a tie, and the return from its level to the close."""
    w = Window.partitionBy("symbol", "day").orderBy("ts_ms")
    b = bars.withColumn("k", F.row_number().over(w))
    first = F.col("k") <= open_bars
    everyone = Window.partitionBy("symbol", "day")
    b = b.withColumns({"hi": F.max(F.when(first, F.col("h"))).over(everyone), "lo": F.min(F.when(first, F.col("l"))).over(everyone)})
    d = b.groupBy("symbol", "day").agg(
        F.count("*").alias("n"), F.first("hi").alias("hi"), F.first("lo").alias("lo"), F.max_by("c", "ts_ms").alias("close"),
        F.min(F.when(~first & (F.col("h") > F.col("hi")), F.col("ts_ms"))).alias("up"), F.min(F.when(~first & (F.col("l") < F.col("lo")), F.col("ts_ms"))).alias("down"),
    ).where(F.col("n") >= open_bars + rest)
    rises = F.col("up").isNotNull() & (F.col("down").isNull() | (F.col("up") <= F.col("down")))
    side = F.when(rises, "up").when(F.col("down").isNotNull(), "down")
    d = d.withColumn("side", side).where("side is not null")
    return d.select("symbol", "day", "side", F.when(rises, percent(F.col("close"), F.col("hi"))).otherwise(percent(F.col("lo"), F.col("close"))).alias("ret"))
