"""Registered queries of votes, levels, structure, options and trade economics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.functions import options
from candlemill.functions.quantile import at_shares
from candlemill.operators import decisions, indicators, regime, structure
from candlemill.plans.market import BASICS, DAYW, IND, MERGED, ROUND, TRADES, _graded, _recursive, _trades, graded_sql, phi, query, rounded, same
from candlemill.sources import archive
from candlemill.sources.testdata import BARS, VIX, bars, load, volatility

RATE = 0.065

# indicators and quotes

#: Every third bar without volume, so that a session may start without any.
SILENT = BASICS + ", q AS (SELECT * REPLACE (CASE WHEN (ts_ms // 900000) % 3 = 0 THEN 0.0 ELSE v END AS v) FROM b)"
#: Sums are folded in order of time, as a window in Spark adds them up; those of an engine's choosing differ in the last digit.
_UPTO = lambda x: f"list_reduce(list({x}) {DAYW}, lambda y, z: y + z)"
VWAPS = f"SELECT symbol, ts_ms, day, CASE WHEN sum(v) {DAYW} > 0 THEN {_UPTO('(h + l + c) / 3 * v')} / sum(v) {DAYW} END AS vwap, {_UPTO('(h + l + c) / 3')} / count(*) {DAYW} AS plain FROM q"


def _silent(spark, d):
    return bars(spark, d).withColumn("v", F.when(F.expr("(ts_ms div 900000) % 3 = 0"), 0.0).otherwise(F.col("v")))


@query(f"WITH {SILENT}, x AS ({VWAPS}) SELECT symbol, ts_ms, floor(vwap * 1e6 + 0.5::DOUBLE) / 1e6 AS vwap, floor(coalesce(vwap, plain) * 1e6 + 0.5::DOUBLE) / 1e6 AS chart_vwap FROM x")
def c10_running_vwap(spark, d):
    """Session VWAP as the replay (C10) and the chart (C11) have it, on bars of which a third is silent."""
    b = structure.running_vwap(_silent(spark, d))
    near = lambda x: (F.floor(F.col(x) * 1e6 + 0.5) / 1e6).alias(x)  # noqa: E731 - engines round halves each in its own way
    return b.select("symbol", "ts_ms", near("vwap"), near("chart_vwap"))


@query(f"WITH {IND} SELECT symbol, ts_ms, round(rsi, 6) AS rsi FROM i QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) <= 40")
def c18_rsi_history(spark, d):
    b = indicators.with_basics(bars(spark, d)).withColumn("rsi", indicators.rsi())
    return rounded(archive.latest(b, 40).select("symbol", "ts_ms", "rsi"))


@query(f"WITH {BARS}, s AS (SELECT symbol, max(ts_ms) AS last_ms FROM bars GROUP BY symbol) SELECT symbol, last_ms, (SELECT max(last_ms) FROM s) + 900000 - last_ms > 1800000 AS stale FROM s")
def b9_staleness(spark, d):
    """Series whose newest bar is over two bars old while the market is open, as of one bar after the newest of all."""
    s = bars(spark, d).groupBy("symbol").agg(F.max("ts_ms").alias("last_ms"))
    now = s.agg((F.max("last_ms") + 900_000).alias("now"))
    return s.crossJoin(F.broadcast(now)).select("symbol", "last_ms", (F.col("now") - F.col("last_ms") > 1_800_000).alias("stale"))


@query(f"""WITH {BASICS}, z AS (SELECT symbol, day, first(o ORDER BY ts_ms) AS open, max(h) AS high, min(l) AS low, last(c ORDER BY ts_ms) AS current FROM b GROUP BY 1, 2),
y AS (SELECT *, lag(current) OVER w AS prev_close, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM z WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, day, {ROUND('open', 'high', 'low', 'current', 'prev_close')}, round(CASE WHEN prev_close <> 0 THEN (current - prev_close) / prev_close * 100 ELSE 0 END, 6) AS change_pct FROM y WHERE k = 1""")
def b18_session_quote(spark, d):
    """The latest session of each series and its change from the close before."""
    b = indicators.previous_close(bars(spark, d))
    day = b.groupBy("symbol", "day").agg(F.min_by("o", "ts_ms").alias("open"), F.max("h").alias("high"), F.min("l").alias("low"), F.max_by("c", "ts_ms").alias("current"), F.max_by("prev_close", "ts_ms").alias("prev_close"), F.max_by("day_change", "ts_ms").alias("change_pct"))
    newest = F.max_by(F.struct("day", "open", "high", "low", "current", "prev_close", "change_pct"), "day").alias("x")
    return rounded(day.groupBy("symbol").agg(newest).select("symbol", "x.*"))


FIGURES = {
    "pe": "c_acctbal / 100", "pb": "(c_custkey % 25) / 2.0", "roe": "c_custkey % 40 - 5.0", "margin": "c_custkey % 33 - 8.0", "debt": "c_custkey % 200 + 0.0", "earnings": "c_custkey % 61 - 30.0",
    "revenue": "c_custkey % 41 - 20.0", "peg": "(c_custkey % 30) / 10.0", "target": "88.0 + c_custkey % 37",
    "rating": "CASE c_custkey % 5 WHEN 0 THEN 'strong_buy' WHEN 1 THEN 'hold' WHEN 2 THEN 'underperform' WHEN 3 THEN 'sell' END",
}


@query(f"""WITH f AS (SELECT c_custkey AS id, {', '.join(f'{e} AS {k}' for k, e in FIGURES.items())} FROM customer)
SELECT id, CAST(CASE WHEN pe > 0 AND pe < 15 THEN 1 WHEN pe > 45 THEN -1 ELSE 0 END + CASE WHEN pb > 0 AND pb < 1.5 THEN 0.5 WHEN pb > 10 THEN -0.5 ELSE 0 END + CASE WHEN roe >= 15 THEN 1 WHEN roe < 5 THEN -0.5 ELSE 0 END
 + CASE WHEN margin < 0 THEN -1 WHEN margin >= 15 THEN 0.5 ELSE 0 END + CASE WHEN debt > 150 THEN -1 WHEN debt < 40 THEN 0.5 ELSE 0 END + CASE WHEN earnings >= 10 THEN 0.5 WHEN earnings <= -10 THEN -0.5 ELSE 0 END
 + CASE WHEN revenue >= 10 THEN 0.5 WHEN revenue <= -5 THEN -0.5 ELSE 0 END + CASE WHEN peg > 0 AND peg < 1 THEN 0.5 ELSE 0 END + CASE WHEN target >= 112 THEN 1 WHEN target <= 92 THEN -1 ELSE 0 END
 + CASE WHEN rating LIKE '%buy%' THEN 0.5 WHEN rating LIKE '%sell%' OR rating LIKE '%underperform%' THEN -0.5 ELSE 0 END AS DOUBLE) AS score FROM f""")
def b12_fundamentals(spark, d):
    f = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), *(F.expr(e).cast("string" if k == "rating" else "double").alias(k) for k, e in FIGURES.items()))
    return f.select("id", decisions.fundamentals({k: F.col(k) for k in FIGURES}, F.lit(100.0)).alias("score"))


# votes and levels

RULES = (
    ("rsi < 35", "rsi > 65", 2), ("bb_upper > 0 AND c <= bb_lower", "bb_upper > 0 AND c >= bb_upper", 2), ("c > vwap", "c < vwap", 1),
    ("or_ready AND c > or_high", "or_ready AND c < or_low", 2), ("stoch < 20", "stoch > 80", 1),
)
_side = lambda k: " + ".join(f"CASE WHEN {r[k]} THEN {r[2]} ELSE 0 END" for r in RULES)
VOTES = f"""{IND}, v1 AS (SELECT *, v < 2 AND h = l AND n % 7 = 0 AS thin, CAST({_side(0)} + CASE WHEN ret_5 >= 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS buy_w, CAST({_side(1)} + CASE WHEN ret_5 <= -0.5 THEN 1 ELSE 0 END AS DOUBLE) AS sell_w FROM i),
v2 AS (SELECT *, CASE WHEN thin THEN 'HOLD' WHEN buy_w - sell_w >= 2 THEN 'BUY' WHEN buy_w - sell_w <= -2 THEN 'SELL' ELSE 'HOLD' END AS action,
 floor(least(90.0::DOUBLE, 42 + abs(buy_w - sell_w) / CASE WHEN buy_w + sell_w = 0 THEN 1 ELSE buy_w + sell_w END * 35 + abs(buy_w - sell_w) * 4) + 0.5::DOUBLE) AS raw FROM v1),
votes AS (SELECT *, CAST(CASE WHEN action <> 'HOLD' THEN raw WHEN thin THEN greatest(35, greatest(38, raw - 12) - 5) ELSE greatest(38, raw - 12) END AS INT) AS confidence FROM v2),
l1 AS (SELECT *, CASE WHEN action = 'BUY' THEN CASE WHEN resistance > c THEN least(c + c * 0.015::DOUBLE, resistance * 0.999::DOUBLE) ELSE c + c * 0.015::DOUBLE END
  ELSE CASE WHEN support > 0 AND support < c THEN greatest(c - c * 0.015::DOUBLE, support * 1.001::DOUBLE) ELSE c - c * 0.015::DOUBLE END END AS goal, greatest(atr * 0.8::DOUBLE, c * 0.002::DOUBLE) AS fl FROM votes),
l2 AS (SELECT *, abs(goal - c) AS reward, action <> 'HOLD' AND abs(goal - c) > 0 AND abs(goal - c) / 1.5::DOUBLE >= fl AS viable, least(abs(goal - c) / 1.5::DOUBLE, greatest(c * 0.008::DOUBLE, fl)) AS risk FROM l1),
lev AS (SELECT *, CASE WHEN viable THEN goal END AS target, CASE WHEN viable THEN CASE WHEN action = 'BUY' THEN c - risk ELSE c + risk END END AS stop, CASE WHEN viable THEN reward / risk END AS rr FROM l2)"""


def _votes(spark, d):
    """Bars with a vote of five indicator factors and the five-bar drift."""
    b = indicators.with_indicators(bars(spark, d)).withColumn("thin", F.expr("v < 2 and h = l and n % 7 = 0"))
    said = [F.struct(F.when(F.expr(up), "BUY").when(F.expr(down), "SELL").alias("type"), F.lit(float(w)).alias("weight")) for up, down, w in RULES]
    return decisions.vote(b.withColumn("factors", F.array(*said)), change="ret_5")


@query(f"WITH {VOTES} SELECT symbol, ts_ms, buy_w, sell_w, action, confidence FROM votes")
def f3_factor_vote(spark, d):
    return _votes(spark, d).select("symbol", "ts_ms", "buy_w", "sell_w", "action", "confidence")


@query(f"WITH {VOTES} SELECT symbol, ts_ms, viable, {ROUND('target', 'stop', 'rr')} FROM lev")
def f4_trade_levels(spark, d):
    return rounded(decisions.levels(_votes(spark, d)).select("symbol", "ts_ms", "viable", "target", "stop", "rr"))


# the ratio is not compared with 2 at equality: the stop's floor makes 1.5 the only exact value
@query(f"WITH {VOTES} SELECT symbol, ts_ms, CASE WHEN viable THEN action ELSE 'HOLD' END AS action, CAST(CASE WHEN action <> 'HOLD' AND NOT viable THEN greatest(35, confidence - 20) WHEN viable AND rr >= 2 THEN least(94, confidence + 3) ELSE confidence END AS INT) AS confidence FROM lev")
def f5_final_call(spark, d):
    return decisions.final_call(decisions.levels(_votes(spark, d))).select("symbol", "ts_ms", "action", "confidence")


VIXED = f"{VIX}, {TRADES}, p AS (SELECT day, lag(close) OVER (ORDER BY day) AS vix FROM vix), tv AS (SELECT trades.*, vix, CASE WHEN line = 7 THEN 'HOLD' WHEN label = 1 THEN 'BUY' ELSE 'SELL' END AS action, 40 + score AS confidence FROM trades LEFT JOIN p ON p.day = trades.day)"


def _vixed(spark, d):
    t = regime.with_previous_close(_trades(spark, d), volatility(spark, d))
    return t.withColumn("action", F.expr("CASE WHEN line = 7 THEN 'HOLD' WHEN label = 1 THEN 'BUY' ELSE 'SELL' END")).withColumn("confidence", 40 + F.col("score"))


@query(f"""WITH {VIXED}, r AS (SELECT *, CASE WHEN action = 'HOLD' THEN 'direction' WHEN confidence < 55 THEN 'confidence' END AS rejected FROM tv),
s AS (SELECT *, CASE WHEN rejected IS NULL THEN CASE WHEN vix > 18 THEN 'vix' WHEN score < 20 THEN 'score' END END AS declined FROM r) SELECT id, line, rejected, declined, rejected IS NULL AND declined IS NULL AS taken FROM s""")
def f19_policy_verdict(spark, d):
    return decisions.verdict(_vixed(spark, d), 55, 18, 20).select("id", "line", "rejected", "declined", "taken")


@query(f"WITH {VIXED} SELECT pool, count(vix) AS matched, count(*) - count(vix) AS unmatched FROM tv GROUP BY pool")
def d7_vix_matches(spark, d):
    return _vixed(spark, d).groupBy("pool").agg(F.count("vix").alias("matched"), (F.count("*") - F.count("vix")).alias("unmatched"))


@query(f"""WITH {VIXED}, k AS (SELECT quantile_disc(score, 0.5) AS cut FROM tv), g AS (SELECT pts, coalesce(vix <= 18, FALSE) AS calm, score >= cut AS kept FROM tv, k),
x AS (SELECT 'neither' AS arm, pts FROM g UNION ALL SELECT 'gate', pts FROM g WHERE calm UNION ALL SELECT 'filter', pts FROM g WHERE kept UNION ALL SELECT 'both', pts FROM g WHERE calm AND kept)
SELECT arm, count(*) AS trades, round(avg(pts), 6) AS mean_pts, round(sum(pts), 4) AS total FROM x GROUP BY arm""")
def e18_gate_and_filter(spark, d):
    """Trades under neither rule, the volatility gate, the score filter, and both."""
    t = _vixed(spark, d)
    cut = at_shares(t, [], "score", {"cut": 0.5})
    calm, kept = F.coalesce(F.col("vix") <= 18, F.lit(False)), F.col("score") >= F.col("cut")
    arms = F.array(F.lit("neither"), F.when(calm, "gate"), F.when(kept, "filter"), F.when(calm & kept, "both"))
    x = t.crossJoin(F.broadcast(cut)).select("pts", F.explode(F.filter(arms, lambda a: a.isNotNull())).alias("arm"))
    return x.groupBy("arm").agg(F.count("*").alias("trades"), F.round(F.avg("pts"), 6).alias("mean_pts"), F.round(F.sum("pts"), 4).alias("total"))


@query(f"WITH RECURSIVE {MERGED}, {graded_sql()} SELECT g.symbol, g.first_ms, CASE WHEN status = 'target' THEN 1 ELSE 0 END AS label, round((resolved_price - entry) * CASE action WHEN 'BUY' THEN 1 ELSE -1 END, 6) AS points, round((f.first - g.first_ms) / 3600000.0, 6) AS hold_hours FROM graded g JOIN f ON f.sid = g.sid WHERE status IN ('target', 'stop')")
def f20_labelled_dataset(spark, d):
    """Resolved signals as training samples: reached its target or not, signed points, hours held."""
    g = _graded(spark, d).where(F.col("status").isin("target", "stop"))
    sign = F.when(F.col("action") == "BUY", 1).otherwise(-1)
    return rounded(g.select("symbol", "first_ms", F.when(F.col("status") == "target", 1).otherwise(0).alias("label"), ((F.col("resolved_price") - F.col("entry")) * sign).alias("points"), ((F.col("resolved_ms") - F.col("first_ms")) / 3_600_000).alias("hold_hours")))


@query(f"WITH RECURSIVE {MERGED}, {graded_sql()} SELECT symbol, action, first_ms, status FROM graded QUALIFY row_number() OVER (PARTITION BY symbol, action ORDER BY CASE WHEN status IN ('target', 'stop') THEN 3 WHEN status = 'expired' THEN 2 ELSE 1 END DESC, first_ms DESC) = 1")
def g15_log_dedupe(spark, d):
    return decisions.best_entries(_graded(spark, d), ["symbol", "action"], "first_ms").select("symbol", "action", "first_ms", "status")


# economics

STRESS = "SELECT {by}, count(*) AS trades, count(*) FILTER (net > 0) AS winners, round(avg(net), 6) AS mean, round(median(net), 6) AS median, round(sum(net) FILTER (k <= 3), 6) AS best, round(CASE WHEN count(*) > 3 THEN (sum(net) - sum(net) FILTER (k <= 3)) / (count(*) - 3) ELSE 0 END, 6) AS without_best FROM n GROUP BY {by}"
NETS = TRADES + ", n AS (SELECT *, pts - 0.5::DOUBLE AS net, year(day) AS year, row_number() OVER (PARTITION BY {by} ORDER BY pts - 0.5::DOUBLE DESC) AS k FROM trades)"


def _nets(spark, d):
    return _trades(spark, d).withColumn("net", F.col("pts") - 0.5).withColumn("year", F.year("day").cast("long"))


@query("WITH " + NETS.format(by="pool, year(day)") + " " + STRESS.format(by="pool, year"))
def e15_stress_by_year(spark, d):
    """Net results of each pool and year, and what is left without the best three."""
    return rounded(decisions.stress(_nets(spark, d), ["pool", "year"]).drop("total"))


@query("WITH " + NETS.format(by="pool, line") + ", s AS (" + STRESS.format(by="pool, line") + ") SELECT pool, count(*) FILTER (mean > 0) AS positive, count(*) FILTER (mean > 0 AND without_best < 0) AS fragile, count(*) FILTER (mean > 0 AND without_best >= 0) AS solid FROM s GROUP BY pool")
def e32_grid_verdict(spark, d):
    """How many variants (line numbers) pay after costs, and how many only by their best three trades."""
    s = rounded(decisions.stress(_nets(spark, d), ["pool", "line"]))
    n = lambda c: F.count(F.when(c, 1))
    pays, weak = F.col("mean") > 0, F.col("without_best") < 0
    return s.groupBy("pool").agg(n(pays).alias("positive"), n(pays & weak).alias("fragile"), n(pays & ~weak).alias("solid"))


@query(f"WITH {TRADES}, v AS (SELECT line AS variant, count(*) AS trades, avg(pts) AS net FROM trades GROUP BY line) SELECT v.variant, v.trades, round(v.net, 6) AS net, round(v.net - b.net, 6) AS against_base FROM v, v b WHERE b.variant = 1")
def e27_variant_comparison(spark, d):
    v = _trades(spark, d).groupBy(F.col("line").alias("variant")).agg(F.count("*").alias("trades"), F.avg("pts").alias("net"))
    base = v.where("variant = 1").select(F.col("net").alias("base"))
    return rounded(v.crossJoin(F.broadcast(base)).select("variant", "trades", "net", (F.col("net") - F.col("base")).alias("against_base")))


SEEDED = TRADES + ", z AS (SELECT t.*, CAST(g AS INT) AS seed, (t.id * (g + 3) + t.line * 7) % 1009 AS sc FROM trades t, range(5) r(g)), cut AS (SELECT seed, quantile_disc(sc, 0.8) AS cut FROM z GROUP BY seed), kept AS (SELECT z.* FROM z JOIN cut ON cut.seed = z.seed WHERE sc >= cut)"


def _seeded(spark, d):
    """Trades scored by five seeds."""
    t = _trades(spark, d).drop("score").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return t.withColumn("score", (F.col("id") * (F.col("seed") + 3) + F.col("line") * 7) % 1009)


@query(f"WITH {SEEDED}, s AS (SELECT seed, avg(pts) AS net FROM kept GROUP BY seed) SELECT count(*) AS seeds, round(avg(net), 6) AS mean, round(stddev_pop(net), 6) AS sd, round(min(net), 6) AS worst, round(max(net), 6) AS best, count(*) FILTER (net > 0) AS positive FROM s")
def e24_seed_spread(spark, d):
    x = _seeded(spark, d)
    cut = at_shares(x, ["seed"], "score", {"cut": 0.8})
    s = x.join(F.broadcast(cut), "seed").where("score >= cut").groupBy("seed").agg(F.avg("pts").alias("net"))
    return rounded(s.agg(F.count("*").alias("seeds"), F.avg("net").alias("mean"), F.stddev_pop("net").alias("sd"), F.min("net").alias("worst"), F.max("net").alias("best"), F.count(F.when(F.col("net") > 0, 1)).alias("positive")))


@query(f"WITH {SEEDED} SELECT id, line, count(*) AS votes FROM kept GROUP BY id, line HAVING count(*) > 2.5")
def e25_majority_vote(spark, d):
    return decisions.votes(_seeded(spark, d), ["id", "line"], 0.2, 5)


@query(f"WITH {VIXED}, a AS (SELECT id, line FROM tv WHERE vix <= 18) SELECT id, line FROM (SELECT id, line FROM tv WHERE score >= 25 INTERSECT SELECT id, line FROM a INTERSECT SELECT id, line FROM tv WHERE label = 1)")
def h5_trade_sets(spark, d):
    """Trades that are kept, calm and labelled at once."""
    t = _vixed(spark, d)
    ids = lambda c: t.where(c).select("id", "line")
    return ids("score >= 25").intersect(ids("vix <= 18")).intersect(ids("label = 1"))


# structure

ARM = "(PARTITION BY symbol, day ORDER BY ts_ms ROWS BETWEEN"
SWEEPS = f"""{BASICS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts_ms) AS k FROM b),
sw AS (SELECT symbol, day, k, h, l, count(*) OVER p = 2 AND count(*) OVER q = 2 AS whole, max(h) OVER p AS ph, max(h) OVER q AS qh, min(l) OVER p AS pl, min(l) OVER q AS ql FROM k WINDOW p AS {ARM} 2 PRECEDING AND 1 PRECEDING), q AS {ARM} 1 FOLLOWING AND 2 FOLLOWING)),
dd AS (SELECT symbol, day, max(h) AS hi, min(l) AS lo, last(c ORDER BY ts_ms) AS lc FROM b GROUP BY 1, 2), pv AS (SELECT symbol, day, lag(hi) OVER w AS hi, lag(lo) OVER w AS lo, lag(lc) OVER w AS lc FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY day)),
pools AS (SELECT symbol, day, 'buy' AS side, hi AS price, 'previous high' AS kind, 0 AS ord, 0 AS pk, 0 AS known FROM pv UNION ALL SELECT symbol, day, 'sell', lo, 'previous low', 1, 0, 0 FROM pv UNION ALL SELECT symbol, day, 'buy', lc, 'previous close', 2, 0, 0 FROM pv
 UNION ALL SELECT symbol, day, 'sell', lc, 'previous close', 3, 0, 0 FROM pv UNION ALL SELECT symbol, day, 'buy', h, 'session high', 4, k, k + 2 FROM sw WHERE whole AND h >= ph AND h > qh UNION ALL SELECT symbol, day, 'sell', l, 'session low', 5, k, k + 2 FROM sw WHERE whole AND l <= pl AND l < ql),
x AS (SELECT k.symbol, ts_ms, side, price, kind, ord, pk, CASE side WHEN 'buy' THEN h - price ELSE price - l END AS depth FROM k JOIN pools p ON p.symbol = k.symbol AND p.day = k.day AND k.k >= known WHERE CASE side WHEN 'buy' THEN h > price AND c < price ELSE l < price AND c > price END)"""


@query(f"WITH {SWEEPS} SELECT symbol, day, side, round(price, 6) AS price, kind, CAST(known AS INT) AS known FROM pools WHERE price IS NOT NULL")
def g2_pools(spark, d):
    return rounded(structure.pools(bars(spark, d)).select("symbol", "day", "side", "price", "kind", "known"))


@query(f"WITH {SWEEPS} SELECT symbol, ts_ms, side, round(price, 6) AS price, kind, round(depth, 6) AS depth FROM x QUALIFY row_number() OVER (PARTITION BY symbol, ts_ms ORDER BY depth DESC, ord, pk) = 1")
def g3_sweeps(spark, d):
    return rounded(structure.sweeps(bars(spark, d)))


@query(f"""WITH RECURSIVE {SILENT}, {_recursive(20, 'b', 'c', 'e')}, x AS ({VWAPS}), y AS (SELECT b.symbol, b.ts_ms, e.y AS ema, vwap, lag(e.y) OVER w AS pe, lag(vwap) OVER w AS pv FROM b {same('b', 'e')} JOIN x ON x.symbol IS NOT DISTINCT FROM b.symbol AND x.ts_ms = b.ts_ms WINDOW w AS (PARTITION BY b.symbol, b.day ORDER BY b.ts_ms)),
z AS (SELECT *, CASE WHEN pe < pv AND ema >= vwap THEN 'LONG' WHEN pe > pv AND ema <= vwap THEN 'SHORT' END AS direction FROM y) SELECT symbol, ts_ms, direction, round(ema, 6) AS ema, round(vwap, 6) AS vwap FROM z WHERE direction IS NOT NULL""")
def g9_crosses(spark, d):
    return rounded(structure.crosses(_silent(spark, d)))


# options


@query(f"WITH c AS (SELECT l_orderkey AS id, 24000 + 100 * l_linenumber + (l_discount * 1000 - l_tax * 1000) * exp({RATE} * 5 / 365) AS f FROM lineitem) SELECT id, count(*) AS strikes, round(median(f), 6) AS forward FROM c GROUP BY id")
def f11_parity_forward(spark, d):
    """The forward of each chain (an order): the median over strikes of K + (C - P) e^(rT)."""
    k, c, p = F.col("l_linenumber") * 100 + 24000, F.col("l_discount") * 1000, F.col("l_tax") * 1000
    return rounded(load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("strikes"), F.median(k + (c - p) * F.exp(F.lit(RATE * 5 / 365))).alias("forward")))


def _options(spark, d):
    """An option on each line item: forward from its price, strike on the grid of 100, one to seven weeks, 8 to 28 % volatility."""
    f = F.col("l_extendedprice") / 4 + 20000
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), f.alias("forward"), (F.round(f / 100) * 100 + (F.col("l_linenumber") - 4) * 100).alias("strike"),
        (F.col("l_linenumber") * 7 / 365.0).alias("years"), (F.col("l_discount") * 2 + 0.08).alias("vol"), (F.col("l_orderkey") % 2 == 0).alias("is_call"),
    )


def option_sql(f: str, k: str, t: str, vol: str, call: str) -> dict[str, str]:
    """SQL of a Black-76 price, unsigned delta and decay a day, for a forward, strike, years and volatility above 0."""
    root, off = f"({vol} * sqrt({t}))", f"exp(-{RATE} * ({t}))"
    d1 = f"((ln({f} / {k}) + 0.5 * {vol} * {vol} * ({t})) / {root})"
    s = f"(CASE WHEN {call} THEN 1.0 ELSE -1.0 END)"
    return {
        "price": f"({off} * {s} * ({f} * {phi(f'{s} * {d1}')} - {k} * {phi(f'{s} * ({d1} - {root})')}))", "delta": f"({off} * {phi(f'{s} * {d1}')})",
        "theta": f"({f} * exp(-0.5 * {d1} * {d1}) * 0.3989422804014327 * {vol} / (2 * sqrt({t})) / 365.0)",
    }


OPTIONS = """options AS (SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_extendedprice AS DOUBLE) / 4 + 20000 AS forward, round((CAST(l_extendedprice AS DOUBLE) / 4 + 20000) / 100) * 100 + (l_linenumber - 4) * 100 AS strike,
  l_linenumber * 7 / 365.0::DOUBLE AS years, CAST(l_discount AS DOUBLE) * 2 + 0.08 AS vol, l_orderkey % 2 = 0 AS is_call FROM lineitem)"""
_F9 = option_sql("forward", "strike", "years", "vol", "is_call")


@query(f"WITH {OPTIONS} SELECT id, line, is_call, round({_F9['price']}, 4) AS price, round({_F9['delta']}, 6) AS delta, round({_F9['theta']}, 5) AS theta FROM options")
def f9_option_prices(spark, d):
    """Black-76 price, delta and decay."""
    o = _options(spark, d).withColumn("m", options.black76(RATE)("forward", "strike", "years", "vol", "is_call"))
    return o.select("id", "line", "is_call", F.round("m.price", 4).alias("price"), F.round("m.delta", 6).alias("delta"), F.round("m.theta", 5).alias("theta"))


@query()
def f10_implied_vol(spark, d):
    """The volatility that the model's price implies; tests hold it to the volatility that made the price."""
    o = _options(spark, d).withColumn("m", options.black76(RATE)("forward", "strike", "years", "vol", "is_call")).withColumn("price", F.col("m.price")).drop("m")
    return o.withColumn("implied", options.implied_vol(RATE)("price", "forward", "strike", "years", "is_call"))
