"""A day's direction called before it opens, setups of a bar, strategies of factors, and headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.market import percent
from candlemill.functions.scan import ema
from candlemill.operators.decisions import final_call, half_up, levels, vote

# Which strategy a factor's name belongs to; the first match wins.
STRATEGIES = ((r"^(macd|ema|supertrend)\b", "momentum"), (r"^(rsi|bollinger|stochastic)\b|^(support|resistance) zone$|^s/r mid-range$", "reversion"), (r"^vwap\b|^opening range$|^liquidity$", "session"), (r"^fair value gap$", "imbalance"))
# Topic and mood of a headline; the first topic wins, a bad mood over a good one.
TOPICS = (("earn|quarter|revenue|profit", "Earnings"), ("gold|silver|bullion|mcx", "Commodity"), ("bank|auto|it |pharma|sector", "Sector"), ("rbi|gdp|inflation|fed|crude|oil|rupee", "Global"), ("deal|jv|merger|ipo", "Corporate"))
GOOD, BAD = "surge|rally|gain|beat|buy|inflow|jump|up ", "fall|drop|miss|cut|down |loss|outflow|slump|slide"

# What a headline means for the market; the first pattern wins, the first text is for its mood, the second for any other.
IMPACTS = (
    ("rbi|repo rate|interest rate|mpc", "negative", "Bearish for banks short-term; NIFTY may see 0.3–0.8% pressure if rate hike fears persist.", "Supportive for rate-sensitive sectors (auto, realty); NIFTY banks may rally."),
    ("fii|foreign|inflow|outflow", "positive", "Bullish for NIFTY — FII buying typically lifts index heavyweights.", "Bearish near-term — FII selling often drags NIFTY and BANK NIFTY."),
    ("crude|oil|opec", "any", "", "Mixed for India: energy stocks up, but inflation fears can hurt broader NIFTY."),
    ("earnings|quarter|revenue|profit|guidance", "negative", "Negative for IT/large-cap earnings sentiment; may weigh on NIFTY.", "Positive earnings surprise supports index; sector peers may follow."),
    ("bank|credit|npa", "positive", "BANK NIFTY positive; NIFTY gets ~30% weight from financials.", "Banking weakness typically pulls NIFTY down 0.2–0.5%."),
    ("global|fed|us |china|war", "negative", "Risk-off globally — NIFTY often opens gap-down on such headlines.", "Global risk-on supports emerging markets including India."),
)
PLAIN = {
    "positive": "Mildly bullish — supports positive sentiment in related stocks and index.", "negative": "Mildly bearish — may add selling pressure in related sectors.",
    "neutral": "Neutral headline — limited direct NIFTY impact unless volume spikes.",
}


def strategy(name: Column) -> Column:
    """The strategy of a factor's name, null for none."""
    out = F.lit(None).cast("string")
    for pattern, key in reversed(STRATEGIES):
        out = F.when(F.lower(name).rlike(pattern), key).otherwise(out)
    return out


def by_strategy(df: DataFrame, change: str) -> DataFrame:
    """One vote a row and strategy over its own factors(name, type, weight); the drift counts in momentum alone. No shuffle.

    A strategy without a factor is not available and has no action.
    """
    d = df.withColumn("strategy", F.explode(F.array(*(F.lit(s) for _, s in STRATEGIES))))
    own = F.filter("factors", lambda f: f["type"].isNotNull() & (strategy(f["name"]) == F.col("strategy")))
    d = d.withColumn("factors", own).withColumns({"available": F.size("factors") > 0, "__drift": F.when(F.col("strategy") == "momentum", F.col(change)), "__thin": F.lit(False)})
    d = vote(d, change="__drift", thin="__thin").drop("__drift", "__thin")
    return d.withColumns({c: F.when(F.col("available"), F.col(c)) for c in ("action", "confidence")})


def flagged_calls(df: DataFrame, change: str) -> DataFrame:
    """The final call of each row of (c, factors, thin, atr, support, resistance and flags).

    flags is a struct: opening_range (false leaves that factor out), long_only (a SELL holds, before
    levels are looked for), strategy (its factors alone vote, and the change in momentum alone; null:
    all), least_stop, atr_target and atr_stop (see levels(); null: the mode's).
    """
    own = F.col("flags.strategy").isNull() | (F.col("flags.strategy") == "momentum")
    heard = F.filter("factors", lambda f: (F.col("flags.opening_range") | (f["name"] != "Opening range")) & (F.col("flags.strategy").isNull() | (strategy(f["name"]) == F.col("flags.strategy"))))
    d = vote(df.withColumns({"factors": heard, "__drift": F.when(own, F.col(change))}), change="__drift").drop("__drift")
    d = d.withColumn("action", F.when(F.col("flags.long_only") & (F.col("action") == "SELL"), "HOLD").otherwise(F.col("action")))
    return final_call(levels(d, floor_share=F.col("flags.least_stop"), atr_target=F.col("flags.atr_target"), atr_stop=F.col("flags.atr_stop")))


def consensus(split: DataFrame, by: list[str]) -> DataFrame:
    """How the available strategies of by_strategy() agree: counts, lean (NONE, one side, HOLD or MIXED), and whether they conflict."""
    n = lambda side: F.count(F.when(F.col("available") & (F.col("action") == side), 1))
    g = split.groupBy(*by).agg(F.count(F.when(F.col("available"), 1)).alias("total"), n("BUY").alias("buy"), n("SELL").alias("sell"), n("HOLD").alias("hold"))
    buys, sells = F.col("buy") > 0, F.col("sell") > 0
    lean = F.when(F.col("total") == 0, "NONE").when(buys & sells, "MIXED").when(buys, "BUY").when(sells, "SELL").otherwise("HOLD")
    return g.withColumn("lean", lean).withColumn("conflict", buys & sells)


def setups(rsi: Column, macd: Column, close: Column, lower: Column, upper: Column, zone: Column, inside: Column, profit: float = 1.5, stop: float = 0.8) -> Column:
    """The setups of a bar as an array: the gap zone it trades at, if any, and its rung, each with target, stop and reward to risk."""
    struct = lambda tag, kind, strength, prob: F.struct(F.lit(tag).alias("tag"), kind.alias("type"), strength.alias("strength"), prob.alias("prob"))
    gap = F.when(zone.isNotNull(), struct("gap", zone, F.when(inside, "STRONG").otherwise("MODERATE"), F.when(inside, 68).otherwise(60)))
    rung = setup(rsi, macd, close, lower, upper)
    said = F.filter(F.array(gap, F.when(rung.isNotNull(), struct("ladder", rung["type"], rung["strength"], rung["prob"]))), lambda x: x.isNotNull())

    def levelled(x):
        way = F.when(x["type"] == "BUY", 1).otherwise(-1)
        goal, out = close * (1 + way * profit / 100), close * (1 - way * stop / 100)
        return F.struct(x["tag"].alias("tag"), x["type"].alias("type"), x["strength"].alias("strength"), x["prob"].alias("prob"), goal.alias("target"), out.alias("stop"), (F.abs(goal - close) / F.abs(close - out)).alias("rr"))

    return F.transform(said, levelled)


def setup(rsi: Column, macd: Column, close: Column, lower: Column, upper: Column) -> Column:
    """The rung of the momentum ladder that a bar stands on: struct(type, strength, prob), null for none."""
    rung = lambda kind, strength, prob: F.struct(F.lit(kind).alias("type"), F.lit(strength).alias("strength"), F.lit(prob).alias("prob"))
    return (
        F.when((rsi < 30) & (macd > 0), rung("BUY", "STRONG", 72)).when(rsi < 35, rung("BUY", "MODERATE", 62))
        .when((rsi > 70) & (macd < 0), rung("SELL", "STRONG", 70)).when(rsi > 65, rung("SELL", "MODERATE", 58))
        .when(close <= lower * 1.002, rung("BUY", "MODERATE", 64)).when(close >= upper * 0.998, rung("SELL", "MODERATE", 63))
        .when((macd > 0) & rsi.between(40, 60), rung("BUY", "WEAK", 54))
    )


def trend_calls(daily: DataFrame, vix: DataFrame, least: int = 21, margin: float = 0.2) -> DataFrame:
    """(symbol, day, up, down, flat, action, confidence, ret): the call for each day from what stood the evening before, and its open-to-close return.

    Volatility counts where the evening's day has a print and twenty are archived. The series of
    one volatility index is small by nature, so its one window partition is.
    """
    w, v = Window.partitionBy("symbol").orderBy("day"), Window.partitionBy(F.lit(1)).orderBy("day")
    ratio = F.when(F.row_number().over(v) >= 20, F.col("close") / F.avg("close").over(v.rowsBetween(-19, 0)))
    d = ema(daily, "c", 20, "e20", order="day").join(vix.select("day", ratio.alias("ratio")), "day", "left")
    moved = lambda k: percent(F.col("c"), F.lag("c", k).over(w))
    d = d.withColumns({"n": F.row_number().over(w), "m3": moved(3), "m1": moved(1), "at": F.when(F.col("h") > F.col("l"), (F.col("c") - F.col("l")) / (F.col("h") - F.col("l")))})
    d = d.withColumns({"called": F.lead("day").over(w), "ret": F.lead(percent(F.col("c"), F.col("o"))).over(w)})
    points = lambda *rules: sum((F.when(c, weight).otherwise(0) for c, weight in rules), F.lit(0))
    d = d.where((F.col("n") >= least) & F.col("called").isNotNull()).withColumns(
        {
            "up": points((F.col("c") > F.col("e20"), 2), (F.col("m3") > 0.5, 1), (F.col("m1") >= 1, 2), (F.col("at") >= 0.7, 1)),
            "down": points((F.col("c") <= F.col("e20"), 2), (F.col("m3") < -0.5, 1), (F.col("m1") <= -1, 1), (F.col("at") <= 0.3, 1)),
            "flat": points((F.col("m3").between(-0.5, 0.5), 1), (F.col("ratio") >= 1.15, 2)),
        }
    )
    lean = (F.col("up") - F.col("down")) / (F.col("up") + F.col("down") + F.col("flat"))
    action = F.when(lean >= margin, "UP").when(lean <= -margin, "DOWN").otherwise("FLAT")
    agreed = F.when(F.abs(lean) >= margin, 50 + half_up(F.abs(lean) * 45)).otherwise(50 - half_up(F.abs(lean) * 30))
    return d.select("symbol", F.col("called").alias("day"), "up", "down", "flat", action.alias("action"), F.greatest(F.lit(20), F.least(F.lit(90), agreed)).cast("int").alias("confidence"), "ret")


def scorecard(calls: DataFrame) -> DataFrame:
    """(action, days, mean, hit_pct, against_long): a DOWN call is right when the day does not rise; FLAT has no hits."""
    g = calls.groupBy("action").agg(F.count("ret").alias("days"), F.sum("ret").alias("s"), F.avg((F.col("ret") > 0).cast("double")).alias("rose"))
    long = g.agg((F.sum("s") / F.sum("days")).alias("long"))
    mean = F.col("s") / F.col("days")
    hit = F.when(F.col("action") == "UP", F.col("rose") * 100).when(F.col("action") == "DOWN", (1 - F.col("rose")) * 100)
    return g.crossJoin(F.broadcast(long)).select("action", "days", mean.alias("mean"), hit.alias("hit_pct"), (mean - F.col("long")).alias("against_long"))


def buckets(calls: DataFrame) -> DataFrame:
    """(bucket, days, mean, hit_pct) of UP and DOWN calls traded in their direction: all of them, and by confidence."""
    signed = F.when(F.col("action") == "UP", F.col("ret")).otherwise(-F.col("ret"))
    kind = F.when(F.col("confidence") < 60, "50-59").when(F.col("confidence") < 70, "60-69").otherwise("70+")
    t = calls.where("action <> 'FLAT' and ret is not null").select(F.explode(F.array(F.lit("all"), kind)).alias("bucket"), signed.alias("r"))
    return t.groupBy("bucket").agg(F.count("*").alias("days"), F.avg("r").alias("mean"), (F.avg((F.col("r") > 0).cast("double")) * 100).alias("hit_pct"))


def impact(headline: Column, mood: Column) -> Column:
    """The first of IMPACTS whose pattern fits, worded by whether its mood holds."""
    low = F.lower(headline)
    out = F.when(mood == "positive", PLAIN["positive"]).when(mood == "negative", PLAIN["negative"]).otherwise(PLAIN["neutral"])
    for pattern, tested, so, else_ in reversed(IMPACTS):
        out = F.when(low.rlike(pattern), F.when(mood == tested, so).otherwise(else_)).otherwise(out)
    return out


def topic(headline: Column) -> Column:
    low, out = F.lower(headline), F.lit("Market")
    for pattern, name in reversed(TOPICS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def mood(headline: Column) -> Column:
    low = F.lower(headline)
    return F.when(low.rlike(BAD), "negative").when(low.rlike(GOOD), "positive").otherwise("neutral")


def newest_headlines(news: DataFrame, each: int = 12, top: int = 24) -> DataFrame:
    """(headline, ts, tags): the newest few of each query, repeats merged with their tags, and the newest of all; a report with limits by design."""
    k = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("ts")))
    n = news.where("headline <> ''").withColumn("k", k).where(F.col("k") <= each)
    return n.groupBy("headline").agg(F.max("ts").alias("ts"), F.concat_ws(",", F.array_sort(F.collect_set("tag"))).alias("tags")).orderBy(F.desc("ts")).limit(top)


def post_open_calls(calls: DataFrame, sessions: DataFrame, margin: float = 0.2) -> DataFrame:
    """calls(symbol, day, up, down, flat) with what the day has done so far, and the vote anew.

    sessions(symbol, day, prev_close, open, spot, vwap, or_high, or_low, bars) is the day up to now;
    the opening range counts from its third bar. A day without one keeps its evening's points.
    """
    c, s = F.col, calls.join(sessions, ["symbol", "day"], "left")
    gap, since = percent(c("open"), c("prev_close")), percent(c("spot"), c("open"))
    ranged = c("bars") >= 3
    points = lambda *rules: sum((F.when(r, n).otherwise(0) for r, n in rules), F.lit(0))
    s = s.withColumns(
        {
            "up": c("up") + points((gap >= 0.15, 1), (since >= 0.1, 2), (c("spot") > c("vwap"), 2), (ranged & (c("spot") > c("or_high")), 1)),
            "down": c("down") + points((gap <= -0.15, 1), (since <= -0.1, 2), (c("spot") <= c("vwap"), 2), (ranged & (c("spot") < c("or_low")), 1)),
            "flat": c("flat") + points((ranged & c("spot").between(c("or_low"), c("or_high")), 1)),
        }
    )
    lean = (c("up") - c("down")) / (c("up") + c("down") + c("flat"))
    agreed = F.when(F.abs(lean) >= margin, 50 + half_up(F.abs(lean) * 45)).otherwise(50 - half_up(F.abs(lean) * 30))
    action = F.when(lean >= margin, "UP").when(lean <= -margin, "DOWN").otherwise("FLAT")
    return s.select("symbol", "day", "up", "down", "flat", action.alias("action"), F.greatest(F.lit(20), F.least(F.lit(90), agreed)).cast("int").alias("confidence"))
