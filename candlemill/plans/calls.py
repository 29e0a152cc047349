"""Registered queries of setups, strategies, trend calls, headlines and clean-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.functions.scan import ema
from candlemill.operators import grading, indicators, trend
from candlemill.plans.decisions import RULES
from candlemill.plans.market import IND, MERGED, TRADES, _graded, _recursive, _trades, graded_sql, query, rounded, same
from candlemill.sources import archive
from candlemill.sources.testdata import DAILY, MS, VIX, bars, daily, epoch_ms, load, volatility

# landing


@query(f"""WITH r AS (SELECT event_id, event_type AS symbol, CAST(floor({MS} / 900000) AS BIGINT) * 900 AS sec, value FROM events WHERE event_id % 10 IS DISTINCT FROM 0 AND ts IS NOT NULL)
SELECT symbol, sec * 1000 AS ts_ms, round(value, 6) AS o, round(value + 1, 6) AS h FROM r QUALIFY row_number() OVER (PARTITION BY symbol, sec ORDER BY event_id, value NULLS FIRST) = 1""")
def a8_paged_landing(spark, d):
    """Crawled rows [seconds, o, h, l, c, v] in page order; those cut short go, and the first copy of a time stays."""
    e = load(spark, d, "events")
    at, v = (F.floor(epoch_ms("ts") / 900_000) * 900).cast("double"), F.col("value")
    whole = F.array(at, v, v + 1, v - 1, v, F.lit(1.0))
    pages = e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("page"), F.when(F.col("event_id") % 10 == 0, F.slice(whole, 1, 5)).otherwise(whole).alias("row"))
    return rounded(archive.clean_pages(pages).select("symbol", "ts_ms", "o", "h"))


# setups and strategies

NAMES = ("RSI", "Bollinger", "VWAP", "Opening range", "Stochastic")
GROUPS = {"momentum": (), "reversion": (0, 1, 4), "session": (2, 3), "imbalance": ()}
_sum = lambda rows, side: " + ".join(["0", *(f"CASE WHEN {RULES[k][side]} THEN {RULES[k][2]} ELSE 0 END" for k in rows)])
SPLIT = " UNION ALL ".join(f"SELECT symbol, ts_ms, '{s}' AS strategy, CAST({_sum(k, 0)} AS DOUBLE) + CASE WHEN '{s}' = 'momentum' AND ret_5 >= 0.5 THEN 1 ELSE 0 END AS buy_w, CAST({_sum(k, 1)} AS DOUBLE) + CASE WHEN '{s}' = 'momentum' AND ret_5 <= -0.5 THEN 1 ELSE 0 END AS sell_w, {_sum(k, 0)} + {_sum(k, 1)} > 0 AS available FROM i" for s, k in GROUPS.items())


@query(f"""WITH {IND}, x AS ({SPLIT}), y AS (SELECT *, CASE WHEN buy_w - sell_w >= 2 THEN 'BUY' WHEN buy_w - sell_w <= -2 THEN 'SELL' ELSE 'HOLD' END AS act,
 floor(least(90.0::DOUBLE, 42 + abs(buy_w - sell_w) / CASE WHEN buy_w + sell_w = 0 THEN 1 ELSE buy_w + sell_w END * 35 + abs(buy_w - sell_w) * 4) + 0.5::DOUBLE) AS raw FROM x)
SELECT symbol, ts_ms, strategy, available, buy_w, sell_w, CASE WHEN available THEN act END AS action, CAST(CASE WHEN available THEN CASE WHEN act = 'HOLD' THEN greatest(38, raw - 12) ELSE raw END END AS INT) AS confidence FROM y""")
def f6_strategy_votes(spark, d):
    """The vote split by strategy (B16 names the strategy of a factor)."""
    b = indicators.with_indicators(bars(spark, d))
    said = [F.struct(F.lit(n).alias("name"), F.when(F.expr(up), "BUY").when(F.expr(down), "SELL").alias("type"), F.lit(float(w)).alias("weight")) for n, (up, down, w) in zip(NAMES, RULES)]
    return trend.by_strategy(b.withColumn("factors", F.array(*said)), "ret_5").select("symbol", "ts_ms", "strategy", "available", "buy_w", "sell_w", "action", "confidence")


@query(f"""WITH RECURSIVE {IND}, {_recursive(12, 'i', 'c', 'f')}, {_recursive(26, 'i', 'c', 's')}, m AS (SELECT f.symbol, f.n, f.y - s.y AS line FROM f {same('f', 's')}), {_recursive(9, 'm', 'line', 'g')},
x AS (SELECT i.*, line - g.y AS hist FROM i {same('i', 'm', 'g')} WHERE i.n >= 26),
y AS (SELECT symbol, ts_ms, CASE WHEN rsi < 30 AND hist > 0 THEN 72 WHEN rsi < 35 THEN 62 WHEN rsi > 70 AND hist < 0 THEN 70 WHEN rsi > 65 THEN 58 WHEN c <= bb_lower * 1.002 THEN 64 WHEN c >= bb_upper * 0.998 THEN 63 WHEN hist > 0 AND rsi BETWEEN 40 AND 60 THEN 54 END AS prob FROM x)
SELECT symbol, ts_ms, CASE WHEN prob IN (72, 62, 64, 54) THEN 'BUY' ELSE 'SELL' END AS type, CASE WHEN prob >= 70 THEN 'STRONG' WHEN prob = 54 THEN 'WEAK' ELSE 'MODERATE' END AS strength, prob FROM y WHERE prob IS NOT NULL""")
def f1_setups(spark, d):
    """The ladder of RSI, MACD and Bollinger on bars with 26 or more before; the gap-zone setup is not part of it."""
    b = ema(ema(indicators.with_indicators(bars(spark, d)), "c", 12, "fast"), "c", 26, "slow").withColumn("line", F.col("fast") - F.col("slow"))
    b = ema(b, "line", 9, "signal").where("n >= 26")
    s = trend.setup(F.col("rsi"), F.col("line") - F.col("signal"), F.col("c"), F.col("bb_lower"), F.col("bb_upper"))
    return b.select("symbol", "ts_ms", s.alias("s")).where("s is not null").select("symbol", "ts_ms", "s.*")


CALLS = f"""{DAILY}, {VIX}, dn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM daily), {_recursive(20, 'dn', 'c', 'e')},
vr AS (SELECT day, CASE WHEN row_number() OVER w >= 20 THEN close / avg(close) OVER (ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS ratio FROM vix WINDOW w AS (ORDER BY day)),
j AS (SELECT dn.*, e.y AS e20, ratio, (c - lag(c, 3) OVER w) / lag(c, 3) OVER w * 100 AS m3, (c - lag(c) OVER w) / lag(c) OVER w * 100 AS m1, CASE WHEN h > l THEN (c - l) / (h - l) END AS pos, lead(dn.day) OVER w AS called, lead((c - o) / o * 100) OVER w AS ret
 FROM dn {same('dn', 'e')} LEFT JOIN vr ON vr.day = dn.day WINDOW w AS (PARTITION BY dn.symbol ORDER BY dn.day)),
t AS (SELECT symbol, called AS day, ret, CASE WHEN c > e20 THEN 2 ELSE 0 END + CASE WHEN m3 > 0.5 THEN 1 ELSE 0 END + CASE WHEN m1 >= 1 THEN 2 ELSE 0 END + CASE WHEN pos >= 0.7 THEN 1 ELSE 0 END AS up,
 CASE WHEN c <= e20 THEN 2 ELSE 0 END + CASE WHEN m3 < -0.5 THEN 1 ELSE 0 END + CASE WHEN m1 <= -1 THEN 1 ELSE 0 END + CASE WHEN pos <= 0.3 THEN 1 ELSE 0 END AS down, CASE WHEN m3 BETWEEN -0.5 AND 0.5 THEN 1 ELSE 0 END + CASE WHEN ratio >= 1.15 THEN 2 ELSE 0 END AS flat FROM j WHERE n >= 21 AND called IS NOT NULL),
calls AS (SELECT *, (up - down) / (up + down + flat) AS lean, CASE WHEN (up - down) / (up + down + flat) >= 0.2::DOUBLE THEN 'UP' WHEN (up - down) / (up + down + flat) <= -0.2::DOUBLE THEN 'DOWN' ELSE 'FLAT' END AS action FROM t)"""


@query(f"WITH RECURSIVE {CALLS} SELECT symbol, day, up, down, flat, action, CAST(greatest(20, least(90, CASE WHEN action <> 'FLAT' THEN 50 + floor(abs(lean) * 45 + 0.5::DOUBLE) ELSE 50 - floor(abs(lean) * 30 + 0.5::DOUBLE) END)) AS INT) AS confidence FROM calls")
def f16_trend_calls(spark, d):
    """Direction of each day from the evening before (F16), by weighted vote."""
    return trend.trend_calls(daily(spark, d), volatility(spark, d)).drop("ret")


@query(f"WITH RECURSIVE {CALLS} SELECT action, count(ret) AS days, round(avg(ret), 6) AS mean, round(CASE action WHEN 'UP' THEN avg((ret > 0)::INT) * 100 WHEN 'DOWN' THEN (1 - avg((ret > 0)::INT)) * 100 END, 6) AS hit_pct, round(avg(ret) - (SELECT avg(ret) FROM calls), 6) AS against_long FROM calls GROUP BY action")
def e26_trend_scorecard(spark, d):
    """Calls against the day's own return."""
    return rounded(trend.scorecard(trend.trend_calls(daily(spark, d), volatility(spark, d))))


# logs, regimes, holdings


@query(f"""SELECT a.symbol, a.first_ms, CASE WHEN a.status = 'expired' THEN b.status ELSE a.status END AS status, a.status = 'expired' AS changed
FROM (WITH RECURSIVE {MERGED}, {graded_sql(3600000)} SELECT symbol, first_ms, status FROM graded) a JOIN (WITH RECURSIVE {MERGED}, {graded_sql()} SELECT symbol, first_ms, status FROM graded) b ON a.symbol = b.symbol AND a.first_ms = b.first_ms""")
def d6_regrade(spark, d):
    """A log graded after an hour, what was open then graded again over a day; resolved rows stay frozen."""
    log = _graded(spark, d, 3_600_000).withColumn("status", F.when(F.col("status") == "expired", "pending").otherwise(F.col("status")))
    return grading.regrade(log, bars(spark, d), min_points=0.5).select("symbol", "first_ms", "status", "changed")


@query(f"WITH {VIX}, p AS (SELECT day, close, row_number() OVER (ORDER BY day DESC) AS k FROM vix) SELECT 15.0::DOUBLE AS level, round(15.0::DOUBLE / avg(close) FILTER (k <= 20), 6) AS ratio, round(count(*) FILTER (close < 15) / count(*), 6) AS rank FROM p WHERE k <= 252")
def d4_live_context(spark, d):
    """A print that is not archived yet against the last 252 closes."""
    p = volatility(spark, d).orderBy(F.desc("day")).limit(252).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("day"))))
    level = F.lit(15.0)
    return rounded(p.agg(F.first(level).alias("level"), (level / F.avg(F.when(F.col("k") <= 20, F.col("close")))).alias("ratio"), F.avg((F.col("close") < level).cast("double")).alias("rank")))


@query(f"WITH {TRADES} SELECT pool, year(day) AS year, count(*) AS n, round(avg((pts > 0)::INT), 6) AS rate, round((avg((pts > 0)::INT) - 0.5) / sqrt(0.25 / count(*)), 6) AS z FROM trades GROUP BY 1, 2")
def e2_proportion_test(spark, d):
    """Share of winners by pool and year against one half."""
    g = _trades(spark, d).groupBy("pool", F.year("day").cast("long").alias("year")).agg(F.count("*").alias("n"), F.avg((F.col("pts") > 0).cast("double")).alias("rate"))
    return rounded(g.withColumn("z", (F.col("rate") - 0.5) / F.sqrt(F.lit(0.25) / F.col("n"))))


@query("SELECT l_returnflag AS type, 'P' || l_partkey AS name, l_orderkey AS id, l_linenumber AS line, round(l_discount, 6) AS buy FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_partkey ORDER BY CASE WHEN l_discount > 0 THEN 1 ELSE 0 END DESC, l_orderkey, l_linenumber, l_extendedprice) = 1")
def g16_holdings_dedupe(spark, d):
    """One holding a type and name in any case: the first with a cost, else the first."""
    h = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("type"), F.concat(F.lit("p"), F.col("l_partkey")).alias("name"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("buy"), "l_extendedprice")
    w = Window.partitionBy("type", F.upper("name")).orderBy(F.when(F.col("buy") > 0, 1).otherwise(0).desc(), "id", "line", "l_extendedprice")
    return rounded(h.withColumn("k", F.row_number().over(w)).where("k = 1").select("type", F.upper("name").alias("name"), "id", "line", "buy"))


# headlines

HEAD = "split_part(text, chr(10), 1)"
_topic = " ".join(f"WHEN regexp_matches(lower({HEAD}), '{p}') THEN '{n}'" for p, n in trend.TOPICS)


@query(f"SELECT doc_id, CASE {_topic} ELSE 'Market' END AS cat, CASE WHEN regexp_matches(lower({HEAD}), '{trend.BAD}') THEN 'negative' WHEN regexp_matches(lower({HEAD}), '{trend.GOOD}') THEN 'positive' ELSE 'neutral' END AS sentiment FROM documents")
def b15_headline_topics(spark, d):
    """Topic and mood of each document's first line."""
    head = F.substring_index("text", "\n", 1)
    return load(spark, d, "documents").select("doc_id", trend.topic(head).alias("cat"), trend.mood(head).alias("sentiment"))


@query(f"WITH n AS (SELECT {HEAD} AS headline, doc_id AS ts, source AS query, lang AS tag FROM documents WHERE {HEAD} <> ''), k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY ts DESC) <= 12) SELECT headline, max(ts) AS ts, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM k GROUP BY headline ORDER BY max(ts) DESC LIMIT 24")
def h1_newest_headlines(spark, d):
    """Twelve of each source, repeats merged, the newest 24."""
    n = load(spark, d, "documents").select(F.substring_index("text", "\n", 1).alias("headline"), F.col("doc_id").alias("ts"), F.col("source").alias("query"), F.col("lang").alias("tag"))
    return trend.newest_headlines(n)
