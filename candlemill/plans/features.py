"""Registered queries of the full factor list, its vote and the feature table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.market import day_minutes
from candlemill.functions.scan import ema
from candlemill.operators import decisions, indicators, regime, structure
from candlemill.plans.market import IND, _recursive, query, rounded, same
from candlemill.plans.replays import ZONES
from candlemill.sources.testdata import bars, volatility


def analyzed(b: DataFrame) -> DataFrame:
    """Bars with every reading that factors and features use; those without a reading keep nulls."""
    keys = ["symbol", "ts_ms"]
    a = indicators.with_indicators(b)
    for k in (12, 20, 26, 50):
        a = ema(a, "c", k, f"ema_{k}")
    a = ema(a.withColumn("line", F.col("ema_12") - F.col("ema_26")), "line", 9, "signal").withColumn("hist", F.col("line") - F.col("signal"))
    a = a.join(indicators.liquidity(b).select(*keys, "liq_ratio", "liq_label"), keys)
    z = structure.zone_signals(b).select("symbol", "n", F.col("type").alias("zone_type"), F.col("status").alias("zone_status"))
    return a.join(z, ["symbol", "n"], "left")


LIQ = """lt AS (SELECT *, v > 0 AS traded, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts_ms) AS k FROM bars),
lr AS (SELECT *, CASE WHEN traded AND k >= 5 THEN avg(v) OVER (PARTITION BY symbol, traded ORDER BY ts_ms ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(v) OVER (PARTITION BY symbol, traded ORDER BY ts_ms) END AS own FROM lt),
lq AS (SELECT symbol, ts_ms, CASE WHEN k < 5 THEN 'Unknown' WHEN coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ms), 1) >= 1.25 THEN 'High' WHEN coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ms), 1) <= 0.75 THEN 'Low' ELSE 'Normal' END AS liq FROM lr)"""
ALL = f"""{IND}, {', '.join(_recursive(k, 'i', 'c', f'e{k}') for k in (12, 20, 26, 50))}, mm AS (SELECT e12.symbol, e12.n, e12.y - e26.y AS line FROM e12 {same('e12', 'e26')}), {_recursive(9, 'mm', 'line', 'e9')}, {LIQ}, {ZONES},
zs AS (SELECT g.symbol, g.n, CASE side WHEN 'bull' THEN 'BUY' ELSE 'SELL' END AS ztype, coalesce(p, q) IS NOT NULL AS inside FROM g JOIN f ON f.symbol = g.symbol AND f.mid = coalesce(p, q, r)),
an AS (SELECT i.*, line - e9.y AS hist, e20.y AS y20, e50.y AS y50, liq, ztype, inside, greatest(atr * 0.6, (resistance - support) * 0.06) AS near, CASE WHEN resistance = support THEN 1 ELSE resistance - support END AS span
 FROM i {same('i', 'mm', 'e9', 'e20', 'e50')} JOIN lq ON lq.symbol = i.symbol AND lq.ts_ms = i.ts_ms LEFT JOIN zs ON zs.symbol = i.symbol AND zs.n = i.n),
fa AS (SELECT symbol, ts_ms, 'Fair value gap' AS name, ztype AS type, CASE WHEN inside THEN 3 ELSE 2 END AS weight FROM an WHERE ztype IS NOT NULL
 UNION ALL SELECT symbol, ts_ms, CASE WHEN z IN (4, 2) THEN 'Support zone' WHEN z IN (-4, -2) THEN 'Resistance zone' ELSE 'S/R mid-range' END, CASE WHEN z > 1 THEN 'BUY' WHEN z < -1 THEN 'SELL' ELSE 'HOLD' END, abs(z) FROM
  (SELECT symbol, ts_ms, CASE WHEN c - support <= near THEN 4 WHEN resistance - c <= near THEN -4 WHEN (c - support) / span < 0.35 THEN 2 WHEN (c - support) / span > 0.65 THEN -2 ELSE 1 END AS z FROM an)
 UNION ALL SELECT symbol, ts_ms, 'VWAP', CASE WHEN c >= vwap THEN 'BUY' ELSE 'SELL' END, 2 FROM an
 UNION ALL SELECT symbol, ts_ms, 'Opening range', CASE WHEN c > or_high THEN 'BUY' WHEN c < or_low THEN 'SELL' ELSE 'HOLD' END, CASE WHEN c BETWEEN or_low AND or_high THEN 1 ELSE 2 END FROM an WHERE or_ready
 UNION ALL SELECT symbol, ts_ms, 'Liquidity', CASE liq WHEN 'High' THEN 'BUY' ELSE 'HOLD' END, CASE WHEN liq IN ('High', 'Low') THEN 2 ELSE 1 END FROM an
 UNION ALL SELECT symbol, ts_ms, 'RSI', CASE WHEN rsi < 30 THEN 'BUY' WHEN rsi > 70 THEN 'SELL' ELSE 'HOLD' END, 1 FROM an UNION ALL SELECT symbol, ts_ms, 'MACD', CASE WHEN hist > 0 THEN 'BUY' ELSE 'SELL' END, 1 FROM an
 UNION ALL SELECT symbol, ts_ms, 'EMA', CASE WHEN c > y20 AND c > y50 THEN 'BUY' WHEN c < y20 AND c < y50 THEN 'SELL' ELSE 'HOLD' END, 1 FROM an
 UNION ALL SELECT symbol, ts_ms, 'Bollinger', CASE WHEN c <= bb_lower THEN 'BUY' WHEN c >= bb_upper THEN 'SELL' ELSE 'HOLD' END, 1 FROM an)"""


@query(f"WITH RECURSIVE {ALL} SELECT a.symbol, a.ts_ms, name, type, CAST(weight AS DOUBLE) AS weight FROM fa a JOIN an ON an.symbol = a.symbol AND an.ts_ms = a.ts_ms WHERE n >= 50")
def f2_factors(spark, d):
    """Every factor of bars with 50 or more before."""
    f = decisions.with_factors(analyzed(bars(spark, d)).where("n >= 50"))
    return f.select("symbol", "ts_ms", F.explode("factors").alias("x")).select("symbol", "ts_ms", "x.*")


@query(f"""WITH RECURSIVE {ALL}, s AS (SELECT a.symbol, a.ts_ms, coalesce(sum(weight) FILTER (type = 'BUY'), 0) AS buy_w, coalesce(sum(weight) FILTER (type = 'SELL'), 0) AS sell_w FROM fa a GROUP BY 1, 2),
v2 AS (SELECT an.symbol, an.ts_ms, liq = 'Low' AS thin, CAST(buy_w + CASE WHEN ret_5 >= 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS buy_w, CAST(sell_w + CASE WHEN ret_5 <= -0.5 THEN 1 ELSE 0 END AS DOUBLE) AS sell_w FROM s JOIN an ON an.symbol = s.symbol AND an.ts_ms = s.ts_ms WHERE n >= 50),
v3 AS (SELECT *, CASE WHEN thin THEN 'HOLD' WHEN buy_w - sell_w >= 2 THEN 'BUY' WHEN buy_w - sell_w <= -2 THEN 'SELL' ELSE 'HOLD' END AS action, floor(least(90.0::DOUBLE, 42 + abs(buy_w - sell_w) / CASE WHEN buy_w + sell_w = 0 THEN 1 ELSE buy_w + sell_w END * 35 + abs(buy_w - sell_w) * 4) + 0.5::DOUBLE) AS raw FROM v2)
SELECT symbol, ts_ms, buy_w, sell_w, action, CAST(CASE WHEN action <> 'HOLD' THEN raw WHEN thin THEN greatest(35, greatest(38, raw - 12) - 5) ELSE greatest(38, raw - 12) END AS INT) AS confidence FROM v3""")
def f3_full_vote(spark, d):
    """The vote over the full factor list; thin liquidity holds."""
    b = decisions.with_factors(analyzed(bars(spark, d)).where("n >= 50")).withColumn("thin", F.col("liq_label") == "Low")
    return decisions.vote(b, change="ret_5").select("symbol", "ts_ms", "buy_w", "sell_w", "action", "confidence")


def called_bars(b: DataFrame, vix: DataFrame) -> DataFrame:
    """Bars(symbol, ts_ms, o, h, l, c, v) with factors, the final call and its levels, and the volatility context of their day."""
    keys = ["symbol", "ts_ms"]
    a = decisions.with_factors(analyzed(b)).withColumn("thin", F.col("liq_label") == "Low")
    a = a.join(indicators.previous_close(b).select(*keys, F.col("day_change").alias("change_pct")), keys).join(indicators.streaks(b).select(*keys, "streak"), keys)
    a = decisions.final_call(decisions.levels(decisions.vote(a)))
    a = a.withColumns({"minutes": day_minutes(F.col("ts_ms")), "weekday": F.pmod(F.col("day") + 3, F.lit(7)), "dn": F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts_ms"))})
    context = regime.context(vix).select(F.unix_date("day").alias("day"), F.col("level").alias("vix"), F.col("ratio").alias("vix_ratio"), F.col("rank").alias("vix_rank"))
    return a.join(context, "day", "left")


def feature_rows(b: DataFrame, vix: DataFrame) -> DataFrame:
    """Feature rows of bars(symbol, ts_ms, o, h, l, c, v) with the volatility context of their day."""
    return decisions.features(called_bars(b, vix))


@query()
def f14_feature_table(spark, d):
    """The 40 columns that models see, one row a bar."""
    return rounded(feature_rows(bars(spark, d), volatility(spark, d)))
