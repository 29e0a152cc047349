"""Indicators of bars(symbol, ts_ms, o, h, l, c, v) by window functions.

All of them share one shuffle by symbol and one sort; the day windows reuse it, for the day is
in order of the timestamp. Values keep full precision: a rule that
rounds at ties would depend on the order of sums. Rows with too little
history get the neutral value that the rule names. Bars are expected once a (symbol, ts_ms).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.market import session_day


def series():
    return Window.partitionBy("symbol").orderBy("ts_ms")


def of_day():
    return Window.partitionBy("symbol", "day").orderBy("ts_ms")


def last(n: int):
    return series().rowsBetween(1 - n, 0)


def with_basics(bars: DataFrame) -> DataFrame:
    """Adds n (number of the bar), day, and the change and close before."""
    before = F.lag("c").over(series())
    return bars.withColumns({"n": F.row_number().over(series()), "day": session_day(F.col("ts_ms")), "before": before, "change": F.col("c") - before})


def rsi(period: int = 14):
    gain, loss = (F.avg(F.greatest(s * F.col("change"), F.lit(0.0))).over(last(period)) for s in (1, -1))
    return F.when(F.col("n") <= period, 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))


def bollinger(period: int = 20) -> dict:
    mid, sd = F.avg("c").over(last(period)), F.stddev_pop("c").over(last(period))
    full = F.col("n") >= period
    return {f"bb_{k}": F.when(full, mid + m * sd).otherwise(0.0) for k, m in (("upper", 2), ("mid", 0), ("lower", -2))}


def atr(period: int = 14):
    true = F.when(F.col("n") > 1, F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("before")), F.abs(F.col("l") - F.col("before"))))
    return F.coalesce(F.avg(true).over(last(period)), F.lit(0.0))


def stochastic(period: int = 14):
    low, high = F.min("l").over(last(period)), F.max("h").over(last(period))
    return F.when((F.col("n") < period) | (high == low), 50.0).otherwise((F.col("c") - low) / (high - low) * 100)


def session(open_bars: int = 3) -> dict:
    """VWAP and opening range of the day so far; the plain mean of closes while nothing has traded."""
    upto = of_day().rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("h") + F.col("l") + F.col("c")) / 3
    volume = F.sum("v").over(upto)
    number = F.row_number().over(of_day())
    first = number <= open_bars
    return {
        "vwap": F.when(volume > 0, F.sum(typical * F.col("v")).over(upto) / volume).otherwise(F.avg("c").over(upto)),
        "or_high": F.max(F.when(first, F.col("h"))).over(upto),
        "or_low": F.min(F.when(first, F.col("l"))).over(upto),
        "or_ready": number > open_bars,
    }


def returns() -> dict:
    """Returns over 5 and 20 bars and the deviation of the last 20 one-bar returns, in percent; 0 when short or from a close of 0."""
    past = lambda k: F.lag("c", k).over(series())
    ago = lambda k: F.when((F.col("n") > k) & (past(k) != 0), (F.col("c") / past(k) - 1) * 100).otherwise(0.0)
    return {"ret_5": ago(5), "ret_20": ago(20), "vol_20": F.coalesce(F.last("deviation", ignorenulls=True).over(series()), F.lit(0.0))}


def deviation(period: int = 20):
    """Deviation of the last one-bar returns, in percent; a bar after a close of 0 has none, and the period then reaches further back."""
    one = F.when(F.col("before") != 0, F.col("change") / F.col("before") * 100)
    w = Window.partitionBy("symbol", one.isNull()).orderBy("ts_ms").rowsBetween(1 - period, 0)
    return F.when(one.isNotNull() & (F.count(one).over(w) == period), F.stddev_pop(one).over(w))


def with_indicators(bars: DataFrame) -> DataFrame:
    return with_basics(bars).withColumn("deviation", deviation()).withColumns(
        {
            "rsi": rsi(),
            **bollinger(),
            "atr": atr(),
            "stoch": stochastic(),
            "support": F.min("l").over(last(20)),
            "resistance": F.max("h").over(last(20)),
            **session(),
            **returns(),
        }
    ).drop("deviation")


def streaks(bars: DataFrame, cap: int = 20) -> DataFrame:
    """Adds streak: the signed run of closes in one direction; a tie is no rise. Gaps and islands."""
    up = F.col("change") > 0
    b = with_basics(bars).withColumn("turn", F.when(F.col("n") > 1, (up != F.coalesce(F.lag(up).over(series()), ~up)).cast("int")).otherwise(0))
    b = b.withColumn("island", F.sum("turn").over(series()))
    run = F.row_number().over(Window.partitionBy("symbol", "island").orderBy("ts_ms")) - F.when(F.col("island") == 0, 1).otherwise(0)
    size = F.least(run, F.lit(cap))
    return b.withColumn("streak", F.when(F.col("n") == 1, 0).otherwise(F.when(up, size).otherwise(-size))).drop("turn", "island")


def windowed_liquidity(bars: DataFrame, window: int = 375) -> DataFrame:
    """Adds the mean of the last five traded volumes over the mean of those traded in the last window bars, and its label; ratio 1 under five."""
    v = F.when(F.col("v") > 0, F.col("v"))
    w = series().rowsBetween(1 - window, 0)
    five = F.avg("v").over(Window.partitionBy("symbol", F.col("v") > 0).orderBy("ts_ms").rowsBetween(-4, 0))
    t = bars.withColumn("own", F.when(F.col("v") > 0, five)).withColumns({"k": F.count(v).over(w), "mean": F.avg(v).over(w), "recent": F.last("own", ignorenulls=True).over(series())})
    t = t.withColumn("liq_ratio", F.when(F.col("k") >= 5, F.floor(F.col("recent") / F.col("mean") * 100 + 0.5) / 100).otherwise(1.0))
    label = F.when(F.col("k") < 5, "Unknown").when(F.col("liq_ratio") >= 1.25, "High").when(F.col("liq_ratio") <= 0.75, "Low").otherwise("Normal")
    return t.withColumn("liq_label", label).drop("own", "k", "mean", "recent")


def liquidity(bars: DataFrame) -> DataFrame:
    """Adds the mean of the last five traded volumes over the mean of all traded so far, and its label.

    Bars without volume carry the ratio of the last traded bar.
    """
    traded = F.col("v") > 0
    t = bars.withColumn("k", F.sum(traded.cast("int")).over(series()))
    w = Window.partitionBy("symbol", traded).orderBy("ts_ms")
    ratio = F.avg("v").over(w.rowsBetween(-4, 0)) / F.avg("v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("own", F.when(traded & (F.col("k") >= 5), ratio))
    t = t.withColumn("liq_ratio", F.coalesce(F.last("own", ignorenulls=True).over(series()), F.lit(1.0)))
    label = F.when(F.col("k") < 5, "Unknown").when(F.col("liq_ratio") >= 1.25, "High").when(F.col("liq_ratio") <= 0.75, "Low").otherwise("Normal")
    return t.withColumn("liq_label", label).drop("k", "own")


def swings(bars: DataFrame, span: int = 2) -> DataFrame:
    """Adds whether a bar is a swing high or low of its day: at least as far as span bars before, strictly beyond span after."""
    b = bars.withColumn("day", session_day(F.col("ts_ms")))
    before, after = of_day().rowsBetween(-span, -1), of_day().rowsBetween(1, span)
    whole = (F.count("*").over(before) == span) & (F.count("*").over(after) == span)
    return b.withColumns(
        {
            "swing_high": whole & (F.col("h") >= F.max("h").over(before)) & (F.col("h") > F.max("h").over(after)),
            "swing_low": whole & (F.col("l") <= F.min("l").over(before)) & (F.col("l") < F.min("l").over(after)),
        }
    )


def previous_close(bars: DataFrame) -> DataFrame:
    """Adds the last close of the trading day before, null on the first, and the change in percent."""
    b = bars.withColumn("day", session_day(F.col("ts_ms")))
    closes = b.groupBy("symbol", "day").agg(F.max_by("c", "ts_ms").alias("last"))
    closes = closes.select(F.col("symbol").alias("__symbol"), F.col("day").alias("__day"), F.lag("last").over(Window.partitionBy("symbol").orderBy("day")).alias("prev_close"))
    own = F.col("symbol").eqNullSafe(F.col("__symbol")) & (F.col("day") == F.col("__day"))  # bars without a symbol are a series too
    return b.join(closes, own).drop("__symbol", "__day").withColumn("day_change", F.when(F.col("prev_close") != 0, (F.col("c") - F.col("prev_close")) / F.col("prev_close") * 100).otherwise(0.0))


def gap_zones(bars: DataFrame, least: float = 0.0003, reach: int = 80) -> DataFrame:
    """(symbol, n, side, low, high, filled_n) of fair-value gaps; filled by the first bar in reach that trades through.

    A gap lies between the bars before and after a middle bar and is at least a share of its close.
    """
    b = bars.withColumn("n", F.row_number().over(series()))
    w = b.withColumns({"h0": F.lag("h").over(series()), "l0": F.lag("l").over(series()), "h2": F.lead("h").over(series()), "l2": F.lead("l").over(series())})
    bull = F.struct(F.lit("bull").alias("side"), F.col("h0").alias("low"), F.col("l2").alias("high"))
    bear = F.struct(F.lit("bear").alias("side"), F.col("h2").alias("low"), F.col("l0").alias("high"))
    z = w.select("symbol", F.col("n").alias("mid"), "c", F.explode(F.array(bull, bear)).alias("z")).select("symbol", "mid", "c", "z.*")
    z = z.where((F.col("high") - F.col("low")) >= F.col("c") * least)
    later = b.select("symbol", "n", "h", "l", F.floor(F.col("n") / reach).alias("block"))
    spans = z.withColumn("block", F.explode(F.sequence(F.floor((F.col("mid") + 2) / reach), F.floor((F.col("mid") + reach) / reach))))
    through = (F.col("n") >= F.col("mid") + 2) & (F.col("n") <= F.col("mid") + reach) & F.when(F.col("side") == "bull", F.col("l") <= F.col("low")).otherwise(F.col("h") >= F.col("high"))
    hit = spans.join(later, ["symbol", "block"]).where(through).groupBy("symbol", "mid", "side").agg(F.min("n").alias("filled_n"))
    return z.join(hit, ["symbol", "mid", "side"], "left").select("symbol", F.col("mid").alias("n"), "side", "low", "high", "filled_n")
