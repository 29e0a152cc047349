"""Registered queries of the sweep setup, of structure marks and of structure features."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.operators import decisions, holdings, setups
from candlemill.plans.decisions import ARM, FIGURES, VOTES, _votes
from candlemill.plans.market import BASICS, ORACLE, query, rounded
from candlemill.sources.testdata import bars, load

#: Made-up bars move little and come every quarter of an hour, so points are scaled down and few bars make a session.
SMALL = {"min_sweep": 0.5, "stop_buffer": 0.5, "min_risk": 0.5}
GRID = {"base": SMALL, "longs": {**SMALL, "sides": "LONG"}, "shorts": {**SMALL, "sides": "SHORT"}, "gap": {**SMALL, "need_gap": True}, "one to one": {**SMALL, "min_rr": 1.0}, "tight": {**SMALL, "max_risk": 10.0}, "patient": {**SMALL, "break_bars": 24, "entry_bars": 24}, "two a day": {**SMALL, "most_trades": 2}}


def _events(spark, d):
    return setups.sweep_events(bars(spark, d), setups.variants(spark, GRID), least_bars=4)


@query()
def g8_sweep_events(spark, d):
    """Every sweep, break, order, fill and trade of the sweep setup under the variants of a grid."""
    return rounded(_events(spark, d))


@query()
def g8_sweep_funnel(spark, d):
    """How many sweeps broke, armed and filled, and what the trades earned, a row a variant."""
    return rounded(setups.funnel(_events(spark, d)))


@query(f"""WITH {BASICS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts_ms) AS k FROM b),
sw AS (SELECT *, count(*) OVER p = 2 AND count(*) OVER q = 2 AS whole, max(h) OVER p AS ph, max(h) OVER q AS qh, min(l) OVER p AS pl, min(l) OVER q AS ql FROM k WINDOW p AS {ARM} 2 PRECEDING AND 1 PRECEDING), q AS {ARM} 1 FOLLOWING AND 2 FOLLOWING)),
pools AS (SELECT symbol, day, ts_ms, k, 'buy' AS side, h AS price FROM sw WHERE whole AND h >= ph AND h > qh UNION ALL SELECT symbol, day, ts_ms, k, 'sell', l FROM sw WHERE whole AND l <= pl AND l < ql),
t AS (SELECT pools.*, k.ts_ms AS taken_ms, k.h, k.l, k.c FROM pools LEFT JOIN k ON k.symbol = pools.symbol AND k.day = pools.day AND k.k > pools.k + 2 AND CASE side WHEN 'buy' THEN k.h > price ELSE k.l < price END
 QUALIFY row_number() OVER (PARTITION BY pools.symbol, pools.ts_ms, side ORDER BY k.k) = 1), u AS (SELECT *, coalesce(CASE side WHEN 'buy' THEN c < price AND h - price >= 0.5 ELSE c > price AND price - l >= 0.5 END, FALSE) AS swept FROM t)
SELECT symbol, day, ts_ms, side, round(price, 6) AS price, taken_ms, swept, round(CASE WHEN swept THEN CASE side WHEN 'buy' THEN h - price ELSE price - l END END, 6) AS depth FROM u""")
def g7_marked_pools(spark, d):
    """Each session's swings as pools, and how they were taken."""
    return rounded(setups.marked_pools(bars(spark, d), least=0.5))


@query()
def g7_marked_breaks(spark, d):
    """Breaks of each session with their blocks, each swing used once."""
    return rounded(setups.marked_breaks(bars(spark, d)))


@query()
def f15_structure_features(spark, d):
    """Structure features of bars that call."""
    return rounded(setups.structure_features(_votes(spark, d), least=0.5))


SYMBOLS = ("click", "error", "purchase", "signup", "view")
_GOAL = "CASE action WHEN 'BUY' THEN CASE WHEN resistance > c THEN least(c + c * 0.0375::DOUBLE, resistance * 0.999::DOUBLE) ELSE c + c * 0.0375::DOUBLE END ELSE CASE WHEN support > 0 AND support < c THEN greatest(c - c * 0.0375::DOUBLE, support * 1.001::DOUBLE) ELSE c - c * 0.0375::DOUBLE END END"


@query(f"""WITH {VOTES}, fc AS (SELECT symbol, ts_ms, c, atr, support, resistance, CASE WHEN viable THEN action ELSE 'HOLD' END AS action, CASE WHEN action <> 'HOLD' AND NOT viable THEN greatest(35, confidence - 20) WHEN viable AND rr >= 2 THEN least(94, confidence + 3) ELSE confidence END AS confidence FROM lev),
nw AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][doc_id % 5 + 1] AS symbol, doc_id AS ts, CASE WHEN max(toxic) = 1 THEN -1 WHEN max(quality) = 1 THEN 1 ELSE 0 END AS mood FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id),
nk AS (SELECT * FROM nw QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 8), nb AS (SELECT symbol, count(*) AS n_news, CAST(sum(mood) AS INT) AS news FROM nk GROUP BY symbol),
fs AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][id % 5 + 1] AS symbol, CAST(floor(avg(score) + 0.5) AS INT) AS score FROM ({ORACLE['b12_fundamentals']}) GROUP BY 1),
a1 AS (SELECT fc.*, n_news, coalesce(news, 0) AS news, score FROM fc LEFT JOIN nb USING (symbol) LEFT JOIN fs USING (symbol)),
a2 AS (SELECT * EXCLUDE (action, confidence), CASE WHEN news <= -2 AND action = 'BUY' OR news >= 2 AND action = 'SELL' THEN 'HOLD' ELSE action END AS action,
  CASE WHEN news <= -2 AND action = 'BUY' THEN greatest(40, confidence - 15) WHEN news >= 2 AND action = 'SELL' THEN greatest(40, confidence - 12) WHEN news >= 2 AND action = 'BUY' OR news <= -2 AND action = 'SELL' THEN least(92, confidence + 8) ELSE confidence END AS confidence FROM a1),
a3 AS (SELECT * EXCLUDE (action, confidence), CASE WHEN score <= -2 AND action = 'BUY' THEN 'HOLD' ELSE action END AS action, CASE WHEN score IS NOT NULL THEN least(95, greatest(30, confidence + floor(least(3, greatest(-3, score)) * 3 + 0.5::DOUBLE))) ELSE confidence END AS confidence FROM a2),
a4 AS (SELECT *, {_GOAL} AS goal, greatest(atr * 0.6::DOUBLE, c * 0.005::DOUBLE) AS fl FROM a3), a5 AS (SELECT *, action <> 'HOLD' AND abs(goal - c) > 0 AND abs(goal - c) / 1.5::DOUBLE >= fl AS viable FROM a4)
SELECT symbol, ts_ms, n_news, news AS news_score, score AS fundamental_score, CASE WHEN viable OR action = 'HOLD' THEN action ELSE 'HOLD' END AS action, CAST(CASE WHEN action <> 'HOLD' AND NOT viable THEN greatest(30, least(95, confidence - 12)) ELSE confidence END AS INT) AS confidence, action <> 'HOLD' AND NOT viable AS gated FROM a5""")
def f7_holding_calls(spark, d):
    """Final calls of each bar turned by the symbol's newest headlines (their mood from labels) and the figures of its companies, then gated by swing levels."""
    calls = decisions.final_call(decisions.levels(_votes(spark, d))).drop("target", "stop", "rr", "viable")
    own = F.array(*(F.lit(s) for s in SYMBOLS))
    mood = load(spark, d, "labels").groupBy("doc_id").agg(F.when(F.max("toxic") == 1, "negative").when(F.max("quality") == 1, "positive").alias("mood"))
    news = load(spark, d, "documents").select("doc_id").join(mood, "doc_id", "left").select(F.get(own, (F.col("doc_id") % 5).cast("int")).alias("symbol"), F.col("doc_id").alias("ts"), "mood")
    firms = load(spark, d, "customer").select(F.get(own, (F.col("c_custkey") % 5).cast("int")).alias("symbol"), *(F.expr(e).cast("string" if k == "rating" else "double").alias(k) for k, e in FIGURES.items()))
    scores = firms.groupBy("symbol").agg(F.floor(F.avg(decisions.fundamentals({k: F.col(k) for k in FIGURES}, F.lit(100.0))) + 0.5).cast("int").alias("fundamental_score"))
    x = calls.join(holdings.news_balance(news), "symbol", "left").join(scores, "symbol", "left")
    x = holdings.gated_view(decisions.levels(holdings.holding_view(x), "swing"))
    return x.select("symbol", "ts_ms", "n_news", F.coalesce("news_score", F.lit(0)).alias("news_score"), "fundamental_score", "action", "confidence", "gated")
