"""Registered queries of flagged calls and their sweeps, consensus, all setups, and the rounded and windowed forms of readings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.functions.scan import ema
from candlemill.operators import grading, holdings, indicators, research, signals, trend
from candlemill.operators.decisions import half_up
from candlemill.plans.calls import CALLS, GROUPS, HEAD, NAMES, SPLIT
from candlemill.plans.decisions import RULES, _silent
from candlemill.plans.features import ALL, analyzed
from candlemill.plans.market import BASICS, IND, MERGED, READINGS, TRADES, _recursive, _trades, economics_sql, graded_sql, phi, query, rounded, same
from candlemill.sources.testdata import bars, daily, load, volatility

#: variant, opening range counts, long only, least stop, target and stop in ranges, strategy.
FLAGS = (
    ("base", True, False, None, None, None, None), ("no opening range", False, False, None, None, None, None), ("long only", True, True, None, None, None, None), ("floor by range", True, False, 0.0, None, None, None),
    ("ranges", True, False, 0.0, 3.0, 1.5, None), ("reversion", True, False, None, None, None, "reversion"), ("session", True, False, None, None, None, "session"), ("momentum", True, False, None, None, None, "momentum"),
)
#: Floors of the stop and a target in ranges, each with both sides and with longs alone.
SWEEP = tuple(
    (f"{name}{' long only' if only else ''}", True, only, floor, times, None, None)
    for name, floor, times in (("floor 0.20", None, None), ("floor 0.15", 0.0015, None), ("floor 0.10", 0.001, None), ("floor 0.05", 0.0005, None), ("floor by range", 0.0, None), ("target of two ranges", 0.0, 2.0))
    for only in (False, True)
)
FLAG_FIELDS = ("variant", "opening_range", "long_only", "least_stop", "atr_target", "atr_stop", "strategy")


def _one_variant(variant, opening, only, least, goal, stop, strategy, scale) -> str:
    heard = [k for k in range(len(RULES)) if (opening or NAMES[k] != "Opening range") and (strategy is None or k in GROUPS[strategy])]
    side = lambda s, drift: " + ".join(["0", *(f"CASE WHEN {RULES[k][s]} THEN {RULES[k][2]} ELSE 0 END" for k in heard), *([f"CASE WHEN {drift} THEN 1 ELSE 0 END"] if strategy in (None, "momentum") else [])])
    number = lambda x: "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"
    return (
        f"SELECT symbol, ts_ms, c, atr / {scale} AS atr, support, resistance, v < 2 AND h = l AND n % 7 = 0 AS thin, '{variant}' AS variant, {only} AS lo, {number(least)} AS least, {number(goal)} AS tgt, {number(stop)} AS stp, "
        f"CAST({side(0, 'ret_5 >= 0.5')} AS DOUBLE) AS buy_w, CAST({side(1, 'ret_5 <= -0.5')} AS DOUBLE) AS sell_w FROM i"
    )


def flagged_sql(variants, scale: float = 1.0) -> str:
    return f"""{IND}, x1 AS ({' UNION ALL '.join(_one_variant(*v, scale) for v in variants)}),
x2 AS (SELECT *, CASE WHEN thin THEN 'HOLD' WHEN buy_w - sell_w >= 2 THEN 'BUY' WHEN buy_w - sell_w <= -2 THEN 'SELL' ELSE 'HOLD' END AS said, floor(least(90.0::DOUBLE, 42 + abs(buy_w - sell_w) / CASE WHEN buy_w + sell_w = 0 THEN 1 ELSE buy_w + sell_w END * 35 + abs(buy_w - sell_w) * 4) + 0.5::DOUBLE) AS raw FROM x1),
x3 AS (SELECT *, CAST(CASE WHEN said <> 'HOLD' THEN raw WHEN thin THEN greatest(35, greatest(38, raw - 12) - 5) ELSE greatest(38, raw - 12) END AS INT) AS sure, CASE WHEN lo AND said = 'SELL' THEN 'HOLD' ELSE said END AS act FROM x2),
x4 AS (SELECT *, CASE WHEN tgt > 0 AND atr > 0 THEN atr * tgt ELSE c * 0.015::DOUBLE END AS wide, CASE WHEN stp > 0 AND atr > 0 THEN atr * stp ELSE c * 0.008::DOUBLE END AS base, greatest(atr * 0.8::DOUBLE, c * coalesce(least, 0.002::DOUBLE)) AS fl FROM x3),
x5 AS (SELECT *, CASE WHEN act = 'BUY' THEN CASE WHEN resistance > c THEN least(c + wide, resistance * 0.999::DOUBLE) ELSE c + wide END ELSE CASE WHEN support > 0 AND support < c THEN greatest(c - wide, support * 1.001::DOUBLE) ELSE c - wide END END AS goal FROM x4),
x6 AS (SELECT *, abs(goal - c) AS reward, act <> 'HOLD' AND abs(goal - c) > 0 AND abs(goal - c) / 1.5::DOUBLE >= fl AS viable, least(abs(goal - c) / 1.5::DOUBLE, greatest(base, fl)) AS risk FROM x5),
fin AS (SELECT symbol, ts_ms, variant, c, viable, CASE WHEN viable THEN act ELSE 'HOLD' END AS action, CAST(CASE WHEN act <> 'HOLD' AND NOT viable THEN greatest(35, sure - 20) WHEN viable AND reward / risk >= 2 THEN least(94, sure + 3) ELSE sure END AS INT) AS confidence,
 CASE WHEN viable THEN goal END AS target, CASE WHEN viable THEN CASE WHEN act = 'BUY' THEN c - risk ELSE c + risk END END AS stop FROM x6)"""


def _flagged(spark, d, variants, scale: float = 1.0):
    """Bars with the five factors, once a variant: the variants are literals, so no shuffle."""
    b = indicators.with_indicators(bars(spark, d)).withColumns({"thin": F.expr("v < 2 and h = l and n % 7 = 0"), "atr": F.col("atr") / scale})
    said = [F.struct(F.lit(name).alias("name"), F.when(F.expr(up), "BUY").when(F.expr(down), "SELL").alias("type"), F.lit(float(w)).alias("weight")) for name, (up, down, w) in zip(NAMES, RULES)]
    kinds = ("string", "boolean", "boolean", "double", "double", "double", "string")
    each = F.array(*(F.struct(*(F.lit(x).cast(k).alias(f) for f, k, x in zip(FLAG_FIELDS, kinds, v))) for v in variants))
    return trend.flagged_calls(b.withColumn("factors", F.array(*said)).withColumn("flags", F.explode(each)), "ret_5").withColumn("variant", F.col("flags.variant"))


@query(f"WITH {flagged_sql(FLAGS)} SELECT symbol, ts_ms, variant, action, confidence, viable, round(target, 6) AS target, round(stop, 6) AS stop FROM fin")
def f5_flagged_calls(spark, d):
    """Every bar's final call under each set of flags."""
    return rounded(_flagged(spark, d, FLAGS).select("symbol", "ts_ms", "variant", "action", "confidence", "viable", "target", "stop"))


SWEPT = f"""{flagged_sql(SWEEP, 50.0)}, readings AS (SELECT symbol || '/' || variant AS symbol, ts_ms, action, c AS entry, target, stop, CAST(confidence AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY symbol, variant ORDER BY ts_ms) AS r FROM fin WHERE viable){MERGED[len(READINGS):]},
{graded_sql().replace("b.symbol = s.symbol", "b.symbol = split_part(s.symbol, '/', 1)").replace("graded AS (", "g0 AS (")}, graded AS (SELECT *, split_part(symbol, '/', 2) AS variant FROM g0)"""


@query(f"WITH RECURSIVE {SWEPT}, " + economics_sql("variant", "'target', 'stop', 'expired'"))
def g19_stop_floor_sweep(spark, d):
    """The replay of the main rules over floors of the stop and a target in ranges, both sides and longs alone. As in g17 the range counts a fiftieth."""
    x = _flagged(spark, d, SWEEP, 50.0).where("viable")
    r = x.select(F.concat_ws("/", "symbol", "variant").alias("symbol"), "ts_ms", "action", F.col("c").alias("entry"), "target", "stop", F.col("confidence").cast("double").alias("confidence"))
    s = signals.merge_signals(r).withColumn("sid", F.concat(F.col("first_ms").cast("string"), "symbol")).withColumn("ts_ms", F.col("first_ms"))
    s = s.withColumn("variant", F.substring_index("symbol", "/", -1)).withColumn("symbol", F.substring_index("symbol", "/", 1))
    return grading.summarize(grading.grade(s, bars(spark, d), min_points=0.5), ["variant"], 0.1, True)


@query(f"""WITH {IND}, x AS ({SPLIT}), y AS (SELECT symbol, ts_ms, CASE WHEN available THEN CASE WHEN buy_w - sell_w >= 2 THEN 'BUY' WHEN buy_w - sell_w <= -2 THEN 'SELL' ELSE 'HOLD' END END AS act FROM x),
z AS (SELECT symbol, ts_ms, count(act) AS total, count(*) FILTER (act = 'BUY') AS buy, count(*) FILTER (act = 'SELL') AS sell, count(*) FILTER (act = 'HOLD') AS hold FROM y GROUP BY 1, 2)
SELECT *, CASE WHEN total = 0 THEN 'NONE' WHEN buy > 0 AND sell > 0 THEN 'MIXED' WHEN buy > 0 THEN 'BUY' WHEN sell > 0 THEN 'SELL' ELSE 'HOLD' END AS lean, buy > 0 AND sell > 0 AS conflict FROM z""")
def f6_consensus(spark, d):
    """How far a bar's strategies agree."""
    b = indicators.with_indicators(bars(spark, d))
    said = [F.struct(F.lit(n).alias("name"), F.when(F.expr(up), "BUY").when(F.expr(down), "SELL").alias("type"), F.lit(float(w)).alias("weight")) for n, (up, down, w) in zip(NAMES, RULES)]
    return trend.consensus(trend.by_strategy(b.withColumn("factors", F.array(*said)), "ret_5"), ["symbol", "ts_ms"])


@query(f"""WITH RECURSIVE {ALL}, pr AS (SELECT symbol, ts_ms, c, CASE WHEN rsi < 30 AND hist > 0 THEN 72 WHEN rsi < 35 THEN 62 WHEN rsi > 70 AND hist < 0 THEN 70 WHEN rsi > 65 THEN 58 WHEN c <= bb_lower * 1.002 THEN 64 WHEN c >= bb_upper * 0.998 THEN 63 WHEN hist > 0 AND rsi BETWEEN 40 AND 60 THEN 54 END AS prob FROM an WHERE n >= 26),
su AS (SELECT symbol, ts_ms, c, 'ladder' AS tag, CASE WHEN prob IN (72, 62, 64, 54) THEN 'BUY' ELSE 'SELL' END AS type, CASE WHEN prob >= 70 THEN 'STRONG' WHEN prob = 54 THEN 'WEAK' ELSE 'MODERATE' END AS strength, prob FROM pr WHERE prob IS NOT NULL
 UNION ALL SELECT symbol, ts_ms, c, 'gap', ztype, CASE WHEN inside THEN 'STRONG' ELSE 'MODERATE' END, CASE WHEN inside THEN 68 ELSE 60 END FROM an WHERE n >= 26 AND ztype IS NOT NULL),
tt AS (SELECT *, round(c * (1 + CASE type WHEN 'BUY' THEN 1 ELSE -1 END * 1.5::DOUBLE / 100), 6) AS target, round(c * (1 - CASE type WHEN 'BUY' THEN 1 ELSE -1 END * 0.8::DOUBLE / 100), 6) AS stop FROM su)
SELECT symbol, ts_ms, tag, type, strength, prob, target, stop FROM tt""")
def f1_all_setups(spark, d):
    """The gap zone a bar trades at and its rung of the ladder, with their levels."""
    c = F.col
    b = analyzed(bars(spark, d)).where("n >= 26")
    s = trend.setups(c("rsi"), c("hist"), c("c"), c("bb_lower"), c("bb_upper"), c("zone_type"), c("zone_status") == "inside")
    return rounded(b.select("symbol", "ts_ms", F.explode(s).alias("s")).select("symbol", "ts_ms", "s.*").drop("rr"))


@query(f"""WITH RECURSIVE {BASICS}, {_recursive(12, 'b', 'c', 'f')}, {_recursive(26, 'b', 'c', 's')},
m AS (SELECT f.symbol, f.n, round(f.y - s.y, 4) AS line FROM f {same('f', 's')}), {_recursive(9, 'm', 'line', 'g')}
SELECT b.symbol, b.ts_ms, CASE WHEN b.n < 26 THEN 0 ELSE floor(line * 1000 + 0.5::DOUBLE) / 1000 END AS v, CASE WHEN b.n < 26 THEN 0 ELSE floor(g.y * 1000 + 0.5::DOUBLE) / 1000 END AS s, CASE WHEN b.n < 26 THEN 0 ELSE floor((line - g.y) * 1000 + 0.5::DOUBLE) / 1000 END AS h FROM b {same('b', 'm', 'g')}""")
def c3_macd_reading(spark, d):
    """The indicator's form: the line has four digits before its average, and all is 0 under 26 bars."""
    b = ema(ema(indicators.with_basics(bars(spark, d)), "c", 12, "fast"), "c", 26, "slow").withColumn("line", F.round(F.col("fast") - F.col("slow"), 4))
    b = ema(b, "line", 9, "signal").withColumn("n", F.row_number().over(indicators.series()))
    shown = lambda x: F.when(F.col("n") < 26, 0.0).otherwise(half_up(x * 1000) / 1000)
    return b.select("symbol", "ts_ms", shown(F.col("line")).alias("v"), shown(F.col("signal")).alias("s"), shown(F.col("line") - F.col("signal")).alias("h"))


@query("WITH " + BASICS + """, q AS (SELECT * REPLACE (CASE WHEN (ts_ms // 900000) % 3 = 0 THEN 0.0 ELSE v END AS v) FROM b),
t AS (SELECT *, CASE WHEN v > 0 THEN avg(v) OVER (PARTITION BY symbol, v > 0 ORDER BY ts_ms ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS own, count(CASE WHEN v > 0 THEN v END) OVER w AS k, avg(CASE WHEN v > 0 THEN v END) OVER w AS mean FROM q WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 374 PRECEDING AND CURRENT ROW)),
u AS (SELECT *, CASE WHEN k >= 5 THEN floor(last_value(own IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ms) / mean * 100 + 0.5::DOUBLE) / 100 ELSE 1 END AS liq_ratio FROM t)
SELECT symbol, ts_ms, liq_ratio, CASE WHEN k < 5 THEN 'Unknown' WHEN liq_ratio >= 1.25 THEN 'High' WHEN liq_ratio <= 0.75 THEN 'Low' ELSE 'Normal' END AS liq_label FROM u""")
def c8_windowed_liquidity(spark, d):
    """Liquidity within the window of 375 bars, on bars of which a third is silent."""
    return indicators.windowed_liquidity(_silent(spark, d)).select("symbol", "ts_ms", "liq_ratio", "liq_label")


@query(f"WITH {TRADES}, g AS (SELECT pool, year(day) AS year, count(*) AS n, avg((pts > 0)::INT) AS rate FROM trades GROUP BY 1, 2), z AS (SELECT *, (rate - 0.5) / sqrt(0.25 / n) AS t FROM g), p AS (SELECT *, 2 * (1 - {phi('abs(t)')}) AS p, 0.05 / greatest(count(*) OVER (), 1) AS bar FROM z) SELECT pool, year, n, round(rate, 6) AS rate, round(t, 4) AS z, round(sqrt(rate * (1 - rate)), 6) AS sd, round(p, 6) AS p, n < 30 AS few, p < bar AND n >= 30 AS survives FROM p")
def e2_proportion_p(spark, d):
    """Winners by pool and year against one half, with p and the Bonferroni verdict."""
    g = _trades(spark, d).groupBy("pool", F.year("day").cast("long").alias("year")).agg(F.count("*").alias("n"), F.avg((F.col("pts") > 0).cast("double")).alias("rate"))
    p = research.with_p_values(g.withColumn("t", (F.col("rate") - 0.5) / F.sqrt(F.lit(0.25) / F.col("n"))))
    rate = F.col("rate")
    return p.select("pool", "year", "n", F.round(rate, 6).alias("rate"), F.round("t", 4).alias("z"), F.round(F.sqrt(rate * (1 - rate)), 6).alias("sd"), F.round("p", 6).alias("p"), (F.col("n") < 30).alias("few"), "survives")


@query(f"""WITH RECURSIVE {CALLS}, k AS (SELECT action, ret, CAST(greatest(20, least(90, 50 + floor(abs(lean) * 45 + 0.5::DOUBLE))) AS INT) AS sure FROM calls WHERE action <> 'FLAT' AND ret IS NOT NULL),
x AS (SELECT CASE action WHEN 'UP' THEN ret ELSE -ret END AS r, CASE WHEN sure < 60 THEN '50-59' WHEN sure < 70 THEN '60-69' ELSE '70+' END AS bucket FROM k), y AS (SELECT bucket, r FROM x UNION ALL SELECT 'all', r FROM x)
SELECT bucket, count(*) AS days, round(avg(r), 6) AS mean, round(avg((r > 0)::INT) * 100, 6) AS hit_pct FROM y GROUP BY bucket""")
def e26_confidence_buckets(spark, d):
    """Calls traded in their direction, all and by confidence."""
    return rounded(trend.buckets(trend.trend_calls(daily(spark, d), volatility(spark, d))))


_MOOD = f"CASE WHEN regexp_matches(lower({HEAD}), '{trend.BAD}') THEN 'negative' WHEN regexp_matches(lower({HEAD}), '{trend.GOOD}') THEN 'positive' ELSE 'neutral' END"
_ladder = " ".join(f"WHEN regexp_matches(head, '{p}') THEN CASE mood WHEN '{m}' THEN '{so}' ELSE '{no}' END" for p, m, so, no in trend.IMPACTS)
_plain = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in trend.PLAIN.items())


@query(f"WITH h AS (SELECT doc_id, lower({HEAD}) AS head, {_MOOD} AS mood FROM documents WHERE text IS NOT NULL) SELECT doc_id, mood, CASE {_ladder} ELSE CASE mood {_plain} END END AS impact FROM h")
def b15_headline_impact(spark, d):
    """What each document's first line would mean for the market."""
    h = load(spark, d, "documents").where("text is not null").select("doc_id", F.substring_index("text", "\n", 1).alias("head"))
    h = h.withColumn("mood", trend.mood(F.col("head")))
    return h.select("doc_id", "mood", trend.impact(F.col("head"), F.col("mood")).alias("impact"))



@query("""WITH h AS (SELECT l_suppkey AS owner, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS id, CASE WHEN l_returnflag = 'R' THEN 'mf' ELSE 'stock' END AS type, 'P' || (l_partkey % 20) AS name, CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'Energy' END AS sector, l_discount AS buy, struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice) AS pos FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY owner, type, name ORDER BY CASE WHEN buy > 0 THEN 0 ELSE 1 END, pos) AS k, min(pos) OVER (PARTITION BY owner, type, name) AS first, max(id) OVER (PARTITION BY owner) AS most FROM h),
u AS (SELECT *, id IS NULL OR row_number() OVER (PARTITION BY owner, id ORDER BY first) > 1 AS fresh FROM k WHERE k = 1)
SELECT owner, CASE WHEN fresh THEN coalesce(most, 0) + sum(fresh::INT) OVER (PARTITION BY owner ORDER BY first ROWS UNBOUNDED PRECEDING) ELSE id END::BIGINT AS id, type, name, sector, round(buy, 6) AS buy FROM u""")
def g16_holdings_repair(spark, d):
    """Holdings of each owner (a supplier) with types and sectors put right, one row a type and name, and ids made unique."""
    kind = F.when(F.col("l_returnflag") == "R", "MF").when(F.col("l_returnflag") == "A", "stock").otherwise("Other")
    h = load(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("owner"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).cast("long").alias("id"), kind.alias("type"), F.concat(F.lit("p"), F.col("l_partkey") % 20).alias("name"),
        F.when(F.col("l_linestatus") == "O", "Other").otherwise("Energy").alias("sector"), F.col("l_discount").alias("buy"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_extendedprice").alias("c"),
    )
    return rounded(holdings.dedupe(h, "owner", ["a", "b", "c"]).select("owner", "id", "type", F.upper("name").alias("name"), "sector", "buy"))
