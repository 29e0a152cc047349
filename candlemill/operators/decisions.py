"""Votes, levels, verdicts and the economics of kept trades, as column rules and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.quantile import at_shares

# Shares and floors of the trade levels by mode (target share, stop share, least stop share, least reward to risk, ATR floor).
LEVELS = {"scalp": (0.015, 0.008, 0.002, 1.5, 0.8), "swing": (0.0375, 0.016, 0.005, 1.5, 0.6), "longterm": (0.10, 0.06, 0.01, 1.2, 0.6)}


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def vote(df: DataFrame, factors: str = "factors", change: str = "change_pct", thin: str = "thin", margin: float = 2.0) -> DataFrame:
    """Adds buy_w, sell_w, action and confidence from factors(type, weight); a null or empty array votes by the change alone.

    A drift of half a percent adds one vote, thin liquidity holds, and confidence grows with
    agreement and margin, less for HOLD. A null weight counts 1, a null change none.
    """
    weight = lambda side: F.aggregate(F.filter(F.coalesce(factors, F.array()), lambda f: f["type"] == side), F.lit(0.0), lambda a, f: a + F.coalesce(f["weight"], F.lit(1.0)))
    d = df.withColumns({"buy_w": weight("BUY") + F.when(F.col(change) >= 0.5, 1.0).otherwise(0.0), "sell_w": weight("SELL") + F.when(F.col(change) <= -0.5, 1.0).otherwise(0.0)})
    gap, total = F.col("buy_w") - F.col("sell_w"), F.col("buy_w") + F.col("sell_w")
    held = F.coalesce(thin, F.lit(False))
    action = F.when(held, "HOLD").when(gap >= margin, "BUY").when(gap <= -margin, "SELL").otherwise("HOLD")
    raw = half_up(F.least(F.lit(90.0), 42 + F.abs(gap) / F.when(total == 0, 1.0).otherwise(total) * 35 + F.abs(gap) * 4))
    hold = F.greatest(F.lit(38), raw - 12)
    return d.withColumn("action", action).withColumn("confidence", F.when(F.col("action") != "HOLD", raw).when(held, F.greatest(F.lit(35), hold - 5)).otherwise(hold).cast("int"))


def levels(df: DataFrame, mode: str = "scalp", floor_share: Column | None = None, atr_target: Column | None = None, atr_stop: Column | None = None) -> DataFrame:
    """Adds target, stop, rr and viable to rows of (c, action, atr, support, resistance).

    The target stops short of the next structure, the stop is as wide as the least reward to risk
    allows and at least the volatility floor; where that is impossible nothing is viable. A row's
    floor_share replaces the mode's least stop, atr_target and atr_stop its shares of the price by
    multiples of the range; where they are null, or the range is not above 0, the mode's count.
    """
    goal_pct, stop_pct, least_stop, least_rr, atr_share = LEVELS[mode]
    buy, c, atr = F.col("action") == "BUY", F.col("c"), F.coalesce("atr", F.lit(0.0))
    ranged = lambda times, share: c * share if times is None else F.when((times > 0) & (atr > 0), atr * times).otherwise(c * share)
    wide, base = ranged(atr_target, goal_pct), ranged(atr_stop, stop_pct)
    up = F.when(F.col("resistance") > c, F.least(c + wide, F.col("resistance") * 0.999)).otherwise(c + wide)
    down = F.when((F.col("support") > 0) & (F.col("support") < c), F.greatest(c - wide, F.col("support") * 1.001)).otherwise(c - wide)
    d = df.withColumn("__goal", F.when(buy, up).otherwise(down))
    floor = F.greatest(atr * atr_share, c * (least_stop if floor_share is None else F.coalesce(floor_share, F.lit(least_stop))))
    d = d.withColumns({"__reward": F.abs(F.col("__goal") - c), "__floor": floor})
    ok = F.col("action").isin("BUY", "SELL") & (F.col("__reward") > 0) & (F.col("__reward") / least_rr >= F.col("__floor"))
    risk = F.least(F.col("__reward") / least_rr, F.greatest(base, F.col("__floor")))
    d = d.withColumns({"viable": F.coalesce(ok, F.lit(False)), "__risk": risk})
    return d.withColumns(
        {"target": F.when(F.col("viable"), F.col("__goal")), "stop": F.when(F.col("viable"), F.when(buy, c - F.col("__risk")).otherwise(c + F.col("__risk"))), "rr": F.when(F.col("viable"), F.col("__reward") / F.col("__risk"))}
    ).drop("__goal", "__reward", "__floor", "__risk")


def final_call(df: DataFrame) -> DataFrame:
    """Turns calls that are not viable into HOLD at 20 points less, 35 at least; a reward of twice the risk adds 3, to 94 at most."""
    lost = F.col("action").isin("BUY", "SELL") & ~F.col("viable")
    conf = F.when(lost, F.greatest(F.lit(35), F.col("confidence") - 20)).when(F.col("viable") & (F.col("rr") >= 2), F.least(F.lit(94), F.col("confidence") + 3)).otherwise(F.col("confidence"))
    return df.withColumns({"confidence": conf.cast("int"), "action": F.when(lost, "HOLD").otherwise(F.col("action"))})


def verdict(df: DataFrame, least_confidence: float, gate: float, least_score: float) -> DataFrame:
    """Adds rejected and declined reasons in the policy's order, and taken; an unknown vix or score declines nothing."""
    rejected = F.when(~F.coalesce(F.col("action").isin("BUY", "SELL"), F.lit(False)), "direction").when(F.coalesce("confidence", F.lit(0.0)) < least_confidence, "confidence")
    declined = F.when(F.col("vix") > gate, "vix").when(F.col("score") < least_score, "score")
    d = df.withColumn("rejected", rejected).withColumn("declined", F.when(F.col("rejected").isNull(), declined))
    return d.withColumn("taken", F.col("rejected").isNull() & F.col("declined").isNull())


def fundamentals(f: dict[str, Column], price: Column) -> Column:
    """Score of a company's figures; a missing figure adds nothing."""
    up = (f["target"] - price) / price * 100
    rules = [
        F.when(f["pe"] > 0, F.when(f["pe"] < 15, 1.0).when(f["pe"] > 45, -1.0)),
        F.when(f["pb"] > 0, F.when(f["pb"] < 1.5, 0.5).when(f["pb"] > 10, -0.5)),
        F.when(f["roe"] >= 15, 1.0).when(f["roe"] < 5, -0.5),
        F.when(f["margin"] < 0, -1.0).when(f["margin"] >= 15, 0.5),
        F.when(f["debt"] > 150, -1.0).when(f["debt"] < 40, 0.5),
        F.when(f["earnings"] >= 10, 0.5).when(f["earnings"] <= -10, -0.5),
        F.when(f["revenue"] >= 10, 0.5).when(f["revenue"] <= -5, -0.5),
        F.when((f["peg"] > 0) & (f["peg"] < 1), 0.5),
        F.when(price != 0, F.when(up >= 12, 1.0).when(up <= -8, -1.0)),
        F.when(f["rating"].contains("buy"), 0.5).when(f["rating"].contains("sell") | f["rating"].contains("underperform"), -0.5),
    ]
    return sum((F.coalesce(r, F.lit(0.0)) for r in rules[1:]), F.coalesce(rules[0], F.lit(0.0)))


def stress(trades: DataFrame, by: list[str], net: str = "net", best: int = 3) -> DataFrame:
    """Per group: trades, winners, mean, median, the best few and the mean without them (0 if none is left).

    The filter on the row number is a group limit, which Spark applies before the shuffle too.
    """
    top = trades.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(net)))).where(F.col("__k") <= best)
    top = top.groupBy(*by).agg(F.sum(net).alias("best"))
    g = trades.groupBy(*by).agg(F.count("*").alias("trades"), F.sum((F.col(net) > 0).cast("long")).alias("winners"), F.avg(net).alias("mean"), F.sum(net).alias("total"))
    g = g.join(at_shares(trades, by, net, {"median": 0.5}, middle=True), by)
    return g.join(top, by).withColumn("without_best", F.when(F.col("trades") > best, (F.col("total") - F.col("best")) / (F.col("trades") - best)).otherwise(0.0))


def votes(scored: DataFrame, key: list[str], keep: float, seeds: int) -> DataFrame:
    """Rows of scored(seed, score) kept by more than half the seeds, each at its own threshold."""
    cut = at_shares(scored, ["seed"], "score", {"cut": 1 - keep})
    return scored.join(F.broadcast(cut), "seed").where("score >= cut").groupBy(*key).agg(F.count("*").alias("votes")).where(F.col("votes") > seeds / 2)


def best_entries(log: DataFrame, by: list[str], at: str) -> DataFrame:
    """One row of a log per key: resolved before expired before open, then the newest."""
    rank = F.when(F.col("status").isin("target", "stop"), 3).when(F.col("status") == "expired", 2).otherwise(1)
    return log.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(rank.desc(), F.desc(at)))).where("__k = 1").drop("__k")


def with_factors(df: DataFrame) -> DataFrame:
    """Adds factors(name, type, weight) of a bar in index-scalp mode: structure, session, liquidity, gap zone and indicator rows.

    Bars have c, support, resistance, atr, vwap, or_high, or_low, or_ready, liq_label, zone_type and
    zone_status (null for none), rsi, hist, ema_20, ema_50, bb_lower and bb_upper.
    """
    c = F.col
    factor = lambda name, kind, weight: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(float(weight)).alias("weight"))
    span = F.when(c("resistance") == c("support"), 1.0).otherwise(c("resistance") - c("support"))
    near = F.greatest(c("atr") * 0.6, span * 0.06)
    at = (c("c") - c("support")) / span
    zone = (
        F.when(c("c") - c("support") <= near, factor("Support zone", "BUY", 4)).when(c("resistance") - c("c") <= near, factor("Resistance zone", "SELL", 4))
        .when(at < 0.35, factor("Support zone", "BUY", 2)).when(at > 0.65, factor("Resistance zone", "SELL", 2)).otherwise(factor("S/R mid-range", "HOLD", 1))
    )
    vwap = F.when(c("vwap").isNotNull(), F.when(c("c") >= c("vwap"), factor("VWAP", "BUY", 2)).otherwise(factor("VWAP", "SELL", 2)))
    opened = F.when(c("or_ready"), F.when(c("c") > c("or_high"), factor("Opening range", "BUY", 2)).when(c("c") < c("or_low"), factor("Opening range", "SELL", 2)).otherwise(factor("Opening range", "HOLD", 1)))
    liquid = F.when(c("liq_label") == "High", factor("Liquidity", "BUY", 2)).when(c("liq_label") == "Low", factor("Liquidity", "HOLD", 2)).otherwise(factor("Liquidity", "HOLD", 1))
    weight = F.when(c("zone_status") == "inside", 3.0).otherwise(2.0)
    gap = F.when(c("zone_type").isNotNull(), F.struct(F.lit("Fair value gap").alias("name"), c("zone_type").alias("type"), weight.alias("weight")))

    def row(name, buy, sell):
        return F.when(buy, factor(name, "BUY", 1)).when(sell, factor(name, "SELL", 1)).otherwise(factor(name, "HOLD", 1))

    rows = [
        row("RSI", c("rsi") < 30, c("rsi") > 70), row("MACD", c("hist") > 0, F.lit(True)), row("EMA", (c("c") > c("ema_20")) & (c("c") > c("ema_50")), (c("c") < c("ema_20")) & (c("c") < c("ema_50"))),
        row("Bollinger", c("c") <= c("bb_lower"), c("c") >= c("bb_upper")),
    ]
    said = F.array(gap, F.when((c("support") != 0) & (c("resistance") != 0), zone), vwap, opened, liquid, *rows)
    return df.withColumn("factors", F.filter(said, lambda x: x.isNotNull()))


# Columns of a feature row, in the order that models are fitted with.
FEATURES = (
    "action_buy", "confidence", "rr", "target_dist_pct", "stop_dist_pct", "buy_weight", "sell_weight", "hold_weight", "weight_margin", "n_factors", "rsi",
    "macd_h_pct", "macd_v_pct", "stoch", "bb_pct", "bb_width_pct", "ema20_dist_pct", "ema50_dist_pct", "ema_spread_pct", "atr_pct", "vol_ratio",
    "vwap_dist_pct", "or_pos", "or_ready", "res_dist_pct", "sup_dist_pct", "fvg_inside", "fvg_bull", "chg_pct", "minutes_from_open", "dow",
    "session_bars", "ret_5_pct", "ret_20_pct", "realized_vol_pct", "bar_range_pct", "streak", "vix_level", "vix_vs_20d", "vix_pctile_1y",
)


def features(df: DataFrame) -> DataFrame:
    """(symbol, ts_ms, FEATURES): bars with a final call as rows for a model; what is missing counts 0.

    Bars have what with_factors() and the calls add, and change_pct, line, liq_ratio, minutes,
    weekday, dn (number in the day), streak, vol_20, ret_5, ret_20, vix, vix_ratio and vix_rank.
    """
    c = F.col
    share = lambda x: F.when(c("c") != 0, x / c("c") * 100)
    held = F.aggregate(F.filter("factors", lambda f: f["type"] == "HOLD"), F.lit(0.0), lambda a, f: a + f["weight"])
    both, band, opened = c("buy_w") + c("sell_w"), c("bb_upper") - c("bb_lower"), c("or_high") - c("or_low")
    value = {
        "action_buy": (c("action") == "BUY").cast("double"), "confidence": c("confidence"), "rr": c("rr"), "target_dist_pct": F.abs(share(c("target") - c("c"))), "stop_dist_pct": F.abs(share(c("c") - c("stop"))),
        "buy_weight": c("buy_w"), "sell_weight": c("sell_w"), "hold_weight": held, "weight_margin": F.when(both != 0, (c("buy_w") - c("sell_w")) / both), "n_factors": F.size("factors"),
        "rsi": c("rsi"), "macd_h_pct": share(c("hist")), "macd_v_pct": share(c("line")), "stoch": c("stoch"), "bb_pct": F.when(band > 0, (c("c") - c("bb_lower")) / band).otherwise(0.5), "bb_width_pct": share(band),
        "ema20_dist_pct": share(c("c") - c("ema_20")), "ema50_dist_pct": share(c("c") - c("ema_50")), "ema_spread_pct": share(c("ema_20") - c("ema_50")), "atr_pct": share(c("atr")), "vol_ratio": c("liq_ratio"),
        "vwap_dist_pct": share(c("c") - c("vwap")), "or_pos": F.when(opened > 0, (c("c") - c("or_low")) / opened).otherwise(0.5), "or_ready": c("or_ready").cast("double"), "res_dist_pct": share(c("resistance") - c("c")), "sup_dist_pct": share(c("c") - c("support")),
        "fvg_inside": (c("zone_status") == "inside").cast("double"), "fvg_bull": F.when(c("zone_type") == "BUY", 1.0).when(c("zone_type") == "SELL", -1.0), "chg_pct": c("change_pct"), "minutes_from_open": c("minutes") - 555, "dow": c("weekday"), "session_bars": c("dn"),
        "ret_5_pct": c("ret_5"), "ret_20_pct": c("ret_20"), "realized_vol_pct": c("vol_20"), "bar_range_pct": share(c("h") - c("l")), "streak": c("streak"), "vix_level": c("vix"), "vix_vs_20d": c("vix_ratio"), "vix_pctile_1y": c("vix_rank"),
    }
    return df.select("symbol", "ts_ms", *(F.coalesce(value[n].cast("double"), F.lit(0.0)).alias(n) for n in FEATURES))
