"""Registered queries of bands, gap-zone signals, structure breaks, replays with variants and options on trades, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.functions import options
from candlemill.functions.market import day_minutes
from candlemill.operators import decisions, grading, indicators, option_trades, replay, signals, structure, trend
from candlemill.operators.supertrend import supertrend
from candlemill.plans.calls import CALLS
from candlemill.plans.decisions import RATE, VIXED, VOTES, _options, _votes, _vixed, option_sql
from candlemill.plans.market import BASICS, MERGED, READINGS, _recursive, economics_sql, graded_sql, query, rounded, same
from candlemill.sources.testdata import BARS, DAILY, bars, volatility

# series


@query(f"""WITH RECURSIVE {BASICS}, t AS (SELECT symbol, ts_ms, n, c, (h + l) / 2 AS mid, greatest(h - l, abs(h - before), abs(l - before)) AS tr FROM b), u AS (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS first FROM t WHERE n > 1),
r AS (SELECT symbol, n, first AS atr, mid + 3 * first AS upper, mid - 3 * first AS lower, c >= mid AS up, c FROM u WHERE n = 11
 UNION ALL SELECT x.symbol, x.n, natr, nu, nl, CASE WHEN r.up THEN x.c >= nl ELSE x.c > nu END, x.c FROM r JOIN (SELECT *, NULL FROM u) x ON x.symbol = r.symbol AND x.n = r.n + 1, LATERAL (SELECT r.atr + (x.tr - r.atr) / 10 AS natr) p,
 LATERAL (SELECT CASE WHEN r.c > r.upper THEN x.mid + 3 * natr ELSE least(r.upper, x.mid + 3 * natr) END AS nu, CASE WHEN r.c < r.lower THEN x.mid - 3 * natr ELSE greatest(r.lower, x.mid - 3 * natr) END AS nl) q)
SELECT r.symbol, t.ts_ms, round(CASE WHEN up THEN lower ELSE upper END, 6) AS value, up AS rising FROM r JOIN t ON t.symbol = r.symbol AND t.n = r.n""")
def c13_supertrend(spark, d):
    return rounded(supertrend(bars(spark, d)))


ZONES = """w AS (SELECT symbol, n AS mid, c, lag(h) OVER k AS h0, lag(l) OVER k AS l0, lead(h) OVER k AS h2, lead(l) OVER k AS l2 FROM b WINDOW k AS (PARTITION BY symbol ORDER BY ts_ms)),
y AS (SELECT symbol, mid, 'bull' AS side, h0 AS low, l2 AS high FROM w WHERE l2 - h0 >= c * 0.0003 UNION ALL SELECT symbol, mid, 'bear', h2, l0 FROM w WHERE l0 - h2 >= c * 0.0003),
f AS (SELECT y.symbol, mid, any_value(side) AS side, any_value(low) AS low, any_value(high) AS high, min(b.n) FILTER (CASE WHEN side = 'bull' THEN b.l <= y.low ELSE b.h >= y.high END) AS filled FROM y LEFT JOIN b ON b.symbol = y.symbol AND b.n BETWEEN mid + 2 AND mid + 80 GROUP BY 1, 2),
x AS (SELECT b.symbol, b.n, b.c, mid, side, low, high, filled FROM b JOIN f ON f.symbol = b.symbol AND b.n > mid AND b.n < mid + 80 QUALIFY row_number() OVER (PARTITION BY b.symbol, b.n ORDER BY mid DESC) <= 8), v AS (SELECT * FROM x WHERE filled IS NULL OR filled > n),
g AS (SELECT symbol, n, max(mid) FILTER (c BETWEEN low AND high AND side = 'bull') AS p, max(mid) FILTER (c BETWEEN low AND high AND side = 'bear') AS q, max(mid) AS r FROM v GROUP BY 1, 2)"""


@query(f"""WITH {BASICS}, {ZONES}
SELECT g.symbol, CAST(g.n AS INT) AS n, CASE side WHEN 'bull' THEN 'BUY' ELSE 'SELL' END AS type, CASE WHEN coalesce(p, q) IS NULL THEN 'formed' ELSE 'inside' END AS status, round(low, 6) AS low, round(high, 6) AS high FROM g JOIN f ON f.symbol = g.symbol AND f.mid = coalesce(p, q, r)""")
def c15_zone_signals(spark, d):
    return rounded(structure.zone_signals(bars(spark, d)))


_w = lambda a, z: f"(PARTITION BY symbol, day ORDER BY ts_ms ROWS BETWEEN {a} AND {z})"
PAST, KNOWN, LEG = _w("UNBOUNDED PRECEDING", "1 PRECEDING"), _w("UNBOUNDED PRECEDING", "3 PRECEDING"), _w("10 PRECEDING", "1 PRECEDING")
BREAKS = f"""{BASICS}, s1 AS (SELECT *, count(*) OVER p = 2 AND count(*) OVER q = 2 AS whole, max(h) OVER p AS ph, max(h) OVER q AS qh, min(l) OVER p AS pl, min(l) OVER q AS ql, lag(l) OVER w - lead(h) OVER w AS near, lead(l) OVER w - lag(h) OVER w AS far FROM b
 WINDOW w AS (PARTITION BY symbol, day ORDER BY ts_ms), p AS {_w('2 PRECEDING', '1 PRECEDING')}, q AS {_w('1 FOLLOWING', '2 FOLLOWING')}),
s2 AS (SELECT *, CASE WHEN whole AND h >= ph AND h > qh THEN h END AS hi, CASE WHEN whole AND l <= pl AND l < ql THEN l END AS lo, CASE WHEN near > 0 THEN near END AS dropped, CASE WHEN far > 0 THEN far END AS jump FROM s1),
s3 AS (SELECT *, CASE WHEN hi IS NOT NULL THEN coalesce(hi > last_value(hi IGNORE NULLS) OVER {PAST}, FALSE) END AS rose, CASE WHEN lo IS NOT NULL THEN coalesce(lo < last_value(lo IGNORE NULLS) OVER {PAST}, FALSE) END AS fell,
 max(h) OVER {_w('2 PRECEDING', 'CURRENT ROW')} AS top, min(l) OVER {_w('2 PRECEDING', 'CURRENT ROW')} AS bottom FROM s2),
s4 AS (SELECT *, coalesce(last_value(lo IGNORE NULLS) OVER {KNOWN}, min(l) OVER {PAST}) AS low_level, coalesce(last_value(hi IGNORE NULLS) OVER {KNOWN}, max(h) OVER {PAST}) AS high_level, coalesce(last_value(rose IGNORE NULLS) OVER {KNOWN}, FALSE) AS was_rising,
 coalesce(last_value(fell IGNORE NULLS) OVER {KNOWN}, FALSE) AS was_falling, {', '.join(f"arg_max({v}, n) FILTER ({side}) OVER {LEG} AS {name}" for v, side, name in (('l', 'c >= o', 'ul'), ('h', 'c >= o', 'uh'), ('top', 'c >= o', 'ue'), ('l', 'c < o', 'dl'), ('h', 'c < o', 'dh'), ('bottom', 'c < o', 'de')))},
 max(dropped) OVER {LEG} AS most_drop, max(jump) OVER {LEG} AS most_jump FROM s3),
brk AS (SELECT symbol, ts_ms, 'SHORT' AS direction, low_level AS level, CASE WHEN was_rising THEN 'CHoCH' ELSE 'BOS' END AS kind, ul AS block_low, uh AS block_high, ue AS protect, most_drop AS gap FROM s4 WHERE c < low_level
 UNION ALL SELECT symbol, ts_ms, 'LONG', high_level, CASE WHEN was_falling THEN 'CHoCH' ELSE 'BOS' END, dl, dh, de, most_jump FROM s4 WHERE c > high_level)"""


@query(f"WITH {BREAKS} SELECT symbol, ts_ms, direction, kind, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("level", "block_low", "block_high", "protect", "gap")) + " FROM brk")
def g4_breaks(spark, d):
    """Breaks of the reference swing by the close (G4), named (G5), with their block, imbalance and protective extreme."""
    return rounded(structure.breaks(bars(spark, d)))


@query(f"WITH {BASICS} SELECT symbol, day, count(*) AS bars, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM b GROUP BY 1, 2")
def g1_sessions(spark, d):
    b = indicators.with_basics(bars(spark, d))
    return b.groupBy("symbol", "day").agg(F.count("*").alias("bars"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


# replays

VARIANTS = (("base", "both", 0), ("long only", "BUY", 0), ("sure", "both", 80))
REPLAY = f"""{VOTES.replace('atr * 0.8::DOUBLE', 'atr / 50 * 0.8::DOUBLE')}, var(variant, sides, least_conf) AS (VALUES {', '.join(map(str, VARIANTS))}), fc AS (SELECT symbol, ts_ms, action, c AS entry, target, stop, CAST(CASE WHEN rr >= 2 THEN least(94, confidence + 3) ELSE confidence END AS DOUBLE) AS confidence FROM lev WHERE viable),
readings AS (SELECT symbol || '/' || variant AS symbol, ts_ms, action, entry, target, stop, confidence, row_number() OVER (PARTITION BY symbol, variant ORDER BY ts_ms) AS r FROM fc, var WHERE (sides = 'both' OR sides = action) AND confidence >= least_conf){MERGED[len(READINGS):]},
{graded_sql().replace("b.symbol = s.symbol", "b.symbol = split_part(s.symbol, '/', 1)").replace("graded AS (", "g0 AS (")}, graded AS (SELECT *, split_part(symbol, '/', 2) AS variant FROM g0)"""


@query(f"WITH RECURSIVE {REPLAY}, " + economics_sql("variant", "'target', 'stop'"))
def g17_replay_variants(spark, d):
    """Every bar's final call under three variants, merged into signals, graded within a day, and the variants' economics: one plan, indicators once. The made-up bars range widely, so their range counts a fiftieth."""
    b = bars(spark, d)
    calls = decisions.final_call(decisions.levels(_votes(spark, d).withColumn("atr", F.col("atr") / 50)))
    each = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(side).alias("sides"), F.lit(conf).alias("least")) for v, side, conf in VARIANTS))
    called = F.col("viable") & (F.col("action") != "HOLD")
    own = F.filter(each, lambda v: called & ((v["sides"] == "both") | (v["sides"] == F.col("action"))) & (F.col("confidence") >= v["least"]))
    x = calls.select("symbol", "ts_ms", "action", "c", "target", "stop", "confidence", F.explode(own).alias("v"))
    r = x.select(F.concat_ws("/", "symbol", "v.variant").alias("symbol"), "ts_ms", "action", F.col("c").alias("entry"), "target", "stop", F.col("confidence").cast("double").alias("confidence"))
    s = signals.merge_signals(r)
    s = s.withColumn("sid", F.concat(F.col("first_ms").cast("string"), "symbol")).withColumn("ts_ms", F.col("first_ms"))
    s = s.withColumn("variant", F.substring_index("symbol", "/", -1)).withColumn("symbol", F.substring_index("symbol", "/", 1))
    return grading.summarize(grading.grade(s, b, min_points=0.5), ["variant"], 0.1)


CROSS_VARIANTS = (("both", "both", 10.0, 1.5), ("longs", "LONG", 10.0, 1.5), ("loose", "both", 20.0, 0.5))
CROSSES = f"""{BASICS}, {_recursive(9, 'b', 'c', 'e')}, var(variant, sides, stop_pts, min_rr) AS (VALUES {', '.join(map(str, CROSS_VARIANTS))}),
q1 AS (SELECT b.*, e.y AS ema, row_number() OVER d - 1 AS k, count(*) OVER (PARTITION BY b.symbol, b.day) AS bars, sum((h + l + c) / 3 * v) OVER d / sum(v) OVER d AS vwap, min(l) OVER z AS lo, max(h) OVER z AS hi, CAST(floor(((ts_ms + 19800000) % 86400000) / 60000) AS INT) AS minutes
 FROM b {same('b', 'e')} WINDOW d AS (PARTITION BY b.symbol, b.day ORDER BY b.ts_ms), z AS (PARTITION BY b.symbol ORDER BY b.ts_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
q2 AS (SELECT *, lag(ema) OVER w AS pe, lag(vwap) OVER w AS pv, lead(o) OVER w AS entry, lead(ts_ms) OVER w AS entry_ms FROM q1 WINDOW w AS (PARTITION BY symbol, day ORDER BY ts_ms)),
q3 AS (SELECT *, CASE WHEN pe < pv AND ema >= vwap THEN 1 WHEN pe > pv AND ema <= vwap THEN -1 END AS way FROM q2 WHERE bars >= 4),
q4 AS (SELECT q3.*, variant, sides, stop_pts, min_rr, CASE WHEN way = 1 THEN hi ELSE lo END AS target, entry - way * stop_pts::DOUBLE AS stop FROM q3, var WHERE way IS NOT NULL AND k >= 2),
q5 AS (SELECT *, CASE WHEN sides NOT IN ('both', CASE way WHEN 1 THEN 'LONG' ELSE 'SHORT' END) THEN 'side' WHEN minutes >= 900 OR entry IS NULL THEN 'time' WHEN (target - entry) * way <= 0 THEN 'level' WHEN abs(target - entry) < stop_pts::DOUBLE * min_rr::DOUBLE THEN 'reward' ELSE 'taken' END AS free FROM q4),
q6 AS (SELECT a.*, coalesce((SELECT min(p.k) FROM q3 p WHERE p.symbol = a.symbol AND p.day = a.day AND p.k > a.k AND (CASE WHEN a.way = 1 THEN p.l <= a.stop OR p.h >= a.target ELSE p.h >= a.stop OR p.l <= a.target END OR p.minutes >= 920)), a.bars - 1) AS ended, row_number() OVER (PARTITION BY symbol, day, variant ORDER BY k) AS j FROM q5 a),
run AS (SELECT symbol, day, variant, j, free AS verdict, CASE WHEN free = 'taken' THEN ended ELSE -1 END AS busy FROM q6 WHERE j = 1
 UNION ALL SELECT x.symbol, x.day, x.variant, x.j, CASE WHEN x.k <= run.busy THEN 'open' ELSE x.free END, CASE WHEN x.k > run.busy AND x.free = 'taken' THEN x.ended ELSE run.busy END FROM run JOIN (SELECT *, NULL FROM q6) x ON x.symbol = run.symbol AND x.day = run.day AND x.variant = run.variant AND x.j = run.j + 1),
tr AS (SELECT q6.*, run.verdict, p.ts_ms AS exit_ms, CASE WHEN run.verdict = 'taken' THEN CASE WHEN CASE WHEN q6.way = 1 THEN p.l <= q6.stop ELSE p.h >= q6.stop END THEN 'stop' WHEN CASE WHEN q6.way = 1 THEN p.h >= q6.target ELSE p.l <= q6.target END THEN 'target' ELSE 'squareoff' END END AS status, p.c AS pc
 FROM q6 JOIN run USING (symbol, day, variant, j) LEFT JOIN q3 p ON p.symbol = q6.symbol AND p.day = q6.day AND p.k = q6.ended)"""


@query(f"""WITH RECURSIVE {CROSSES} SELECT symbol, variant, ts_ms, CASE way WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS direction, verdict, round(CASE WHEN verdict = 'taken' THEN entry END, 6) AS entry, CASE WHEN verdict = 'taken' THEN exit_ms END AS exit_ms,
 round(CASE status WHEN 'stop' THEN stop WHEN 'target' THEN target WHEN 'squareoff' THEN pc END, 6) AS exit, status FROM tr""")
def g10_cross_replay(spark, d):
    """Every cross of the average with the session's price, under three variants (G19), and the trades that got the slot."""
    variants = spark.createDataFrame(CROSS_VARIANTS, "variant string, sides string, stop_pts double, min_rr double")
    t = replay.cross_trades(bars(spark, d), variants, warmup=2, least_bars=4)
    return rounded(t.select("symbol", "variant", "ts_ms", "direction", "verdict", "entry", "exit_ms", "exit", "status"))


@query(f"""WITH RECURSIVE {CROSSES}, g AS (SELECT variant, verdict, CASE status WHEN 'stop' THEN stop WHEN 'target' THEN target WHEN 'squareoff' THEN pc END - entry AS pts, way FROM tr)
SELECT variant, count(*) AS crosses, count(*) FILTER (verdict = 'taken') AS trades, count(*) FILTER (verdict <> 'taken') AS refused, round(avg(CASE WHEN pts * way > 0 THEN 1.0 WHEN pts * way <= 0 THEN 0 END) * 100, 6) AS win_pct, round(avg(pts * way), 6) AS gross, round(avg(pts * way) - 6, 6) AS net FROM g GROUP BY variant""")
def g19_cross_grid(spark, d):
    """The replay's economics over the grid of variants, at six points a trade."""
    variants = spark.createDataFrame(CROSS_VARIANTS, "variant string, sides string, stop_pts double, min_rr double")
    t = replay.cross_trades(bars(spark, d), variants, warmup=2, least_bars=4)
    pts = (F.col("exit") - F.col("entry")) * F.when(F.col("direction") == "LONG", 1).otherwise(-1)
    n = lambda c: F.count(F.when(c, 1))
    g = t.withColumn("pts", pts).groupBy("variant").agg(F.count("*").alias("crosses"), n(F.col("verdict") == "taken").alias("trades"), n(F.col("verdict") != "taken").alias("refused"), (F.avg((F.col("pts") > 0).cast("double")) * 100).alias("win_pct"), F.avg("pts").alias("gross"))
    return rounded(g.withColumn("net", F.col("gross") - 6))


@query(f"""WITH RECURSIVE {CROSSES}, u AS (SELECT *, max(CASE WHEN way IS NOT NULL THEN ts_ms END) OVER (PARTITION BY symbol, day) AS cross_ms, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) AS back FROM
  (SELECT *, CASE WHEN pe < pv AND ema >= vwap THEN 1 WHEN pe > pv AND ema <= vwap THEN -1 END AS way FROM q2)), x AS (SELECT *, CASE WHEN ema >= vwap THEN 1 ELSE -1 END AS s FROM u WHERE back = 1), y AS (SELECT *, CASE s WHEN 1 THEN hi ELSE lo END AS target FROM x)
SELECT symbol, day, ts_ms, CASE s WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS side, cross_ms, round(c, 6) AS entry, round(target, 6) AS target, round(c - s * 20.5::DOUBLE, 6) AS stop, round(CASE WHEN (target - c) * s > 0 THEN (target - c) * s / 20.5::DOUBLE END, 6) AS rr, coalesce((target - c) * s > 0 AND (target - c) * s / 20.5::DOUBLE >= 1.5, FALSE) AS passes FROM y""")
def g11_cross_reading(spark, d):
    return rounded(structure.cross_reading(bars(spark, d)))


# the day so far

BDAILY = f"{BARS}, bb AS (SELECT *, CAST(floor((ts_ms + 19800000) / 86400000) AS INT) AS dno FROM bars), daily AS (SELECT symbol, DATE '1970-01-01' + dno AS day, first(o ORDER BY ts_ms) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY ts_ms) AS c, sum(v) AS v FROM bb GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {CALLS.replace(DAILY, BDAILY)}, mb AS (SELECT *, row_number() OVER (PARTITION BY symbol, dno ORDER BY ts_ms) AS k FROM bb WHERE (ts_ms + 19800000) % 86400000 < 43200000),
ms AS (SELECT symbol, DATE '1970-01-01' + dno AS day, first(o ORDER BY ts_ms) AS o, last(c ORDER BY ts_ms) AS spot, sum((h + l + c) / 3 * v) / sum(v) AS vwap, max(h) FILTER (k <= 3) AS oh, min(l) FILTER (k <= 3) AS ol, count(*) AS n FROM mb GROUP BY 1, 2),
pc AS (SELECT symbol, day, lag(c) OVER (PARTITION BY symbol ORDER BY day) AS pc FROM daily), j2 AS (SELECT calls.symbol, calls.day, up, down, flat, (o - pc) / pc * 100 AS gap, (spot - o) / o * 100 AS since, spot, vwap, oh, ol, n FROM calls JOIN pc ON pc.symbol = calls.symbol AND pc.day = calls.day LEFT JOIN ms ON ms.symbol = calls.symbol AND ms.day = calls.day),
k2 AS (SELECT symbol, day, up + CASE WHEN gap >= 0.15 THEN 1 ELSE 0 END + CASE WHEN since >= 0.1 THEN 2 ELSE 0 END + CASE WHEN spot > vwap THEN 2 ELSE 0 END + CASE WHEN n >= 3 AND spot > oh THEN 1 ELSE 0 END AS up,
 down + CASE WHEN gap <= -0.15 THEN 1 ELSE 0 END + CASE WHEN since <= -0.1 THEN 2 ELSE 0 END + CASE WHEN spot <= vwap THEN 2 ELSE 0 END + CASE WHEN n >= 3 AND spot < ol THEN 1 ELSE 0 END AS down, flat + CASE WHEN n >= 3 AND spot BETWEEN ol AND oh THEN 1 ELSE 0 END AS flat FROM j2),
l2 AS (SELECT *, (up - down) / (up + down + flat) AS lean FROM k2), a2 AS (SELECT *, CASE WHEN lean >= 0.2::DOUBLE THEN 'UP' WHEN lean <= -0.2::DOUBLE THEN 'DOWN' ELSE 'FLAT' END AS action FROM l2)
SELECT symbol, day, CAST(up AS INT) AS up, CAST(down AS INT) AS down, CAST(flat AS INT) AS flat, action, CAST(greatest(20, least(90, CASE WHEN action <> 'FLAT' THEN 50 + floor(abs(lean) * 45 + 0.5::DOUBLE) ELSE 50 - floor(abs(lean) * 30 + 0.5::DOUBLE) END)) AS INT) AS confidence FROM a2""")
def f17_post_open_calls(spark, d):
    """The evening's call with what the day has done by noon: gap, move since the open, session price, opening range."""
    b = indicators.previous_close(bars(spark, d)).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")))
    daily = b.groupBy("symbol", "day").agg(F.min_by("o", "ts_ms").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts_ms").alias("c"), F.sum("v").alias("v"))
    m = b.where(day_minutes(F.col("ts_ms")) < 720).withColumn("k", F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts_ms")))
    first = F.col("k") <= 3
    sessions = m.groupBy("symbol", "day").agg(
        F.first("prev_close").alias("prev_close"), F.min_by("o", "ts_ms").alias("open"), F.max_by("c", "ts_ms").alias("spot"), (F.sum((F.col("h") + F.col("l") + F.col("c")) / 3 * F.col("v")) / F.sum("v")).alias("vwap"),
        F.max(F.when(first, F.col("h"))).alias("or_high"), F.min(F.when(first, F.col("l"))).alias("or_low"), F.count("*").alias("bars"),
    )
    return trend.post_open_calls(trend.trend_calls(daily, volatility(spark, d)), sessions)


# options on trades

_A, _B, _C = (option_sql(f, "24000.0", t, "iv", "TRUE") for f, t in (("24000.0", "t0"), ("(24000.0 + pts)", "t1"), ("24000.0", "t1")))
PRICED = f"""{VIXED}, q0 AS (SELECT id, line, pool, CAST(pts AS DOUBLE) * 20 AS pts, line * 4.0 - 4 AS given, vix * 0.85::DOUBLE / 100 AS iv, 4.7::DOUBLE / 365 AS t0 FROM tv WHERE vix IS NOT NULL),
q1 AS (SELECT *, CASE WHEN given > 0 THEN given ELSE 6.0 END AS hold_hours FROM q0), q2 AS (SELECT *, greatest(t0 - hold_hours / 24 / 365, 1e-6) AS t1 FROM q1),
q3 AS (SELECT *, {_A['price']} AS entry, {_A['delta']} AS delta, {_B['price']} AS xit, {_C['price']} AS mid, {_C['delta']} AS later FROM q2),
q4 AS (SELECT *, xit - entry AS gross, mid - entry AS theta, entry * 75 AS buy, greatest(xit, 0) * 75 AS sell FROM q3 WHERE entry > 0 AND delta > 0.01), q5 AS (SELECT *, (buy + sell) * 0.0003503::DOUBLE AS ex, (buy + sell) * 0.000001::DOUBLE AS sebi FROM q4),
q6 AS (SELECT *, (40.0 + sell * 0.001::DOUBLE + ex + sebi + buy * 0.00003::DOUBLE + (40.0 + ex + sebi) * 0.18::DOUBLE + 6.0::DOUBLE * 0.05::DOUBLE * 75 * 2) / 75 AS cost, gross - theta - pts * later AS gamma FROM q5), priced AS (SELECT *, (gross - cost) / delta AS net_pts FROM q6)"""


def _priced(spark, d):
    t = _vixed(spark, d).select("id", "line", "pool", "pts", (F.col("line") * 4.0 - 4).alias("hold_hours"), (F.col("vix") * 0.85 / 100).alias("iv"))
    return option_trades.price_trades(t.withColumn("pts", F.col("pts") * 20), RATE)


@query(f"WITH {PRICED} SELECT id, line, pool, round(hold_hours, 4) AS hold_hours, " + ", ".join(f"round({e}, 3) AS {c}" for c, e in {"entry": "entry", "exit": "xit", "delta": "delta", "gross": "gross", "theta": "theta", "gamma": "gamma", "cost": "cost", "net_pts": "net_pts"}.items()) + " FROM priced")
def f8_option_trades(spark, d):
    """Trades as bought calls at the volatility of their day."""
    kept = ("entry", "exit", "delta", "gross", "theta", "gamma", "cost", "net_pts")
    return _priced(spark, d).select("id", "line", "pool", F.round("hold_hours", 4).alias("hold_hours"), *(F.round(c, 3).alias(c) for c in kept))


@query(f"WITH {PRICED} SELECT pool, count(*) AS trades, round(avg(pts), 3) AS index_net, round(avg(net_pts), 3) AS option_net, round(median(hold_hours), 4) AS median_hold, round(avg(theta / delta), 3) AS theta_pts, round(avg(gamma / delta), 3) AS gamma_pts, round(-avg(cost / delta), 3) AS cost_pts, round(sum(net_pts), 1) AS total_net FROM priced GROUP BY pool")
def e30_option_summary(spark, d):
    s = option_trades.repriced(_priced(spark, d), ["pool"])
    return s.select("pool", "trades", *(F.round(c, 4 if c == "median_hold" else 1 if c == "total_net" else 3).alias(c) for c in s.columns if c not in ("pool", "trades")))


def _chain(spark, d):
    """Quotes around the model's price, a chain an order."""
    o = _options(spark, d).withColumn("p", options.black76(RATE)("forward", "strike", "years", "vol", "is_call")["price"])
    o = o.withColumns({"bid": F.col("p") - 0.3, "ask": F.col("p") + 0.3, "volume": F.col("line") % 5})
    return option_trades.measure(o.drop("p", "vol"), RATE)


@query()
def f12_chain_measures(spark, d):
    return _chain(spark, d)


@query()
def f13_cheapest_strikes(spark, d):
    """The cheapest strike of each chain and side with a delta in range."""
    return option_trades.cheapest(_chain(spark, d), ["id"])
