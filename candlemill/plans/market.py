"""Registered market queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.functions import market as m
from candlemill.functions.scan import ema
from candlemill.operators import grading, indicators, regime, research, signals
from candlemill.sources import archive
from candlemill.sources.testdata import BARS, DAILY, VIX, bars, daily, load, volatility

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def six(x: str) -> str:
    """SQL of x to six digits by its decimal form, as Spark rounds; DuckDB's round multiplies first, which from some 1e9 on no longer gives x back."""
    return f"coalesce(CAST(CAST(TRY_CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 6)) AS VARCHAR) AS DOUBLE), {x})"


ROUND = lambda *cols: ", ".join(f"{six(c)} AS {c}" for c in cols)
BASICS = f"""{BARS}, b AS (SELECT *, row_number() OVER w AS n, CAST(floor((ts_ms + 19800000) / 86400000) AS INT) AS day,
  lag(c) OVER w AS before, c - lag(c) OVER w AS change FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))"""


def phi(x: str) -> str:
    """SQL of the normal distribution at x: Simpson's rule over 200 steps from 0, beyond nine deviations flat."""
    z = f"greatest(least({x}, 9.0), -9.0)"
    return f"(0.5 + {z} * list_sum(list_transform(range(0, 201), lambda i: (CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow({z} * i / 200.0, 2)))) / 600.0 * 0.3989422804014327)"


def last(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# sources


@query(f"WITH {BARS} SELECT symbol, ts_ms, {ROUND('o', 'h', 'l', 'c', 'v')} FROM bars WHERE symbol = 'view' AND ts_ms BETWEEN 1704412800000 AND 1705276800000")
def a1_range_read(spark, d):
    return rounded(archive.read_range(bars(spark, d), "view", 1704412800000, 1705276800000))


@query(f"WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) AS k FROM bars) SELECT symbol, ts_ms, {ROUND('o', 'h', 'l', 'c', 'v')} FROM k WHERE k <= 375")
def a2_latest_bars(spark, d):
    return rounded(archive.latest(bars(spark, d), 375))


def _reload(b: DataFrame) -> DataFrame:
    """A later pull: the second half again with other closes, and each series' next bar."""
    new = b.where("ts_ms >= 1705276800000").withColumn("c", F.col("c") + 1)
    return new.unionByName(new.groupBy("symbol").agg(F.max("ts_ms").alias("ts_ms")).withColumn("ts_ms", F.col("ts_ms") + 900000).select("symbol", "ts_ms", *(F.lit(100.0).alias(c) for c in "ohlc"), F.lit(1.0).alias("v")))


RELOAD = f"""{BARS}, again AS (SELECT symbol, ts_ms, o, h, l, c + 1 AS c, v FROM bars WHERE ts_ms >= 1705276800000),
pull AS (SELECT * FROM again UNION ALL SELECT symbol, max(ts_ms) + 900000, 100, 100, 100, 100, 1 FROM again GROUP BY symbol)"""


@query(f"WITH {RELOAD} SELECT symbol, ts_ms, {ROUND('o', 'h', 'l', 'c', 'v')} FROM (SELECT * FROM pull UNION ALL SELECT * FROM bars WHERE (symbol, ts_ms) NOT IN (SELECT symbol, ts_ms FROM pull))")
def a3_upsert(spark, d):
    b = bars(spark, d)
    return rounded(archive.upsert(b, _reload(b)))


@query(f"WITH {RELOAD} SELECT symbol, count(*) AS new_keys FROM pull WHERE (symbol, ts_ms) NOT IN (SELECT symbol, ts_ms FROM bars) GROUP BY symbol")
def a3_new_keys(spark, d):
    b = bars(spark, d)
    return archive.new_keys(b, _reload(b)).groupBy("symbol").agg(F.count("*").alias("new_keys"))


@query(f"WITH {BARS} SELECT symbol, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM bars GROUP BY symbol")
def a5_inventory(spark, d):
    return archive.inventory(bars(spark, d))


# scalars


@query(f"""WITH {BARS}, t AS (SELECT symbol, ts_ms, CAST(floor((ts_ms + 19800000) / 86400000) AS INT) AS day, CAST(floor(((ts_ms + 19800000) % 86400000) / 60000) AS INT) AS minutes FROM bars),
u AS (SELECT *, CAST((day + 3) % 7 AS INT) AS weekday, day = 19748 AS holiday FROM t)
SELECT symbol, ts_ms, day, minutes, weekday, CASE WHEN weekday >= 5 THEN 'weekend' WHEN holiday THEN 'holiday' WHEN minutes < 555 THEN 'pre_open' WHEN minutes > 930 THEN 'post_close' ELSE 'open' END AS status, minutes >= 920 AS past_square_off FROM u""")
def b3_market_status(spark, d):
    """Calendar keys of each bar; the holiday is 26 January 2024."""
    t = bars(spark, d).select("symbol", "ts_ms", m.session_day(F.col("ts_ms")).alias("day"), m.day_minutes(F.col("ts_ms")).alias("minutes"))
    t = t.withColumn("weekday", F.pmod(F.col("day") + 3, F.lit(7)).cast("int"))
    return t.withColumns({"status": m.market_status(F.col("weekday"), F.col("minutes"), F.col("day") == 19748), "past_square_off": F.col("minutes") >= m.SQUARE_OFF})


@query("""WITH span AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders)
SELECT CAST(g AS DATE) AS day FROM span, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS t(g) WHERE isodow(g) <= 5 AND NOT (month(g) = 1 AND day(g) = 26)""")
def b2_trading_days(spark, d):
    """Weekdays between the first and last order, less the yearly holiday of 26 January."""
    span = load(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.where((F.weekday("day") < 5) & ~((F.month("day") == 1) & (F.day("day") == 26)))


@query("""SELECT event_id, least(99, CAST(floor(value) % 40 AS INT) + 60) AS confidence, CASE WHEN least(99, CAST(floor(value) % 40 AS INT) + 60) >= 90 THEN 'Very Strong' WHEN least(99, CAST(floor(value) % 40 AS INT) + 60) >= 85 THEN 'Strong' ELSE 'High' END AS strength
FROM events WHERE event_type IN ('click', 'view', 'purchase') AND least(99, CAST(floor(value) % 40 AS INT) + 60) >= 80""")
def b7_loggable_strength(spark, d):
    """Readings confident enough for the log, with their band."""
    conf = F.least(F.lit(99), (F.floor("value") % 40).cast("int") + 60)
    e = load(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    return e.select("event_id", conf.alias("confidence")).where("confidence >= 80").withColumn("strength", m.strength(F.col("confidence")))


@query("""SELECT DISTINCT 'NSE:NIFTY' || strftime(CAST(o_orderdate AS DATE), '%y') || CASE month(o_orderdate) WHEN 10 THEN 'O' WHEN 11 THEN 'N' WHEN 12 THEN 'D' ELSE CAST(month(o_orderdate) AS VARCHAR) END || strftime(CAST(o_orderdate AS DATE), '%d') || CAST(24000 + 50 * (o_orderkey % 9) AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS weekly,
 'NSE:NIFTY' || strftime(CAST(o_orderdate AS DATE), '%y') || upper(strftime(CAST(o_orderdate AS DATE), '%b')) || CAST(24000 + 50 * (o_orderkey % 9) AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS monthly FROM orders""")
def b8_option_symbol(spark, d):
    """Weekly and monthly exchange symbols of an expiry, strike and side."""
    day, mo = F.to_date("o_orderdate"), F.month("o_orderdate")
    letter = F.when(mo == 10, "O").when(mo == 11, "N").when(mo == 12, "D").otherwise(mo.cast("string"))
    head, tail = F.concat(F.lit("NSE:NIFTY"), F.date_format(day, "yy")), F.concat((F.col("o_orderkey") % 9 * 50 + 24000).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "CE").otherwise("PE"))
    return load(spark, d, "orders").select(F.concat(head, letter, F.date_format(day, "dd"), tail).alias("weekly"), F.concat(head, F.upper(F.date_format(day, "MMM")), tail).alias("monthly")).distinct()


@query("""WITH h AS (SELECT c_custkey AS id, 100 + c_custkey % 50 AS buy, 100 + c_acctbal / 200 AS cur FROM customer),
x AS (SELECT id, (cur - buy) / buy * 100 AS pnl, cur, buy FROM h)
SELECT id, signal, round(pnl, 6) AS pnl FROM (SELECT id, 'buy' AS signal, pnl FROM x WHERE cur <= buy * 0.97 UNION ALL SELECT id, 'take_profit', pnl FROM x WHERE pnl >= 1.5 AND pnl > 0 UNION ALL SELECT id, 'stop_loss', pnl FROM x WHERE pnl < 0 AND -pnl >= 0.8)""")
def b10_holding_signals(spark, d):
    """Rule signals of holdings; a holding may give two."""
    h = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50 + 100).alias("buy"), (F.col("c_acctbal") / 200 + 100).alias("cur"))
    h = h.withColumn("pnl", (F.col("cur") - F.col("buy")) / F.col("buy") * 100)
    said = F.array(F.when(F.col("cur") <= F.col("buy") * 0.97, "buy"), F.when((F.col("pnl") >= 1.5) & (F.col("pnl") > 0), "take_profit"), F.when((F.col("pnl") < 0) & (-F.col("pnl") >= 0.8), "stop_loss"))
    return h.select("id", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("signal"), F.round("pnl", 6).alias("pnl"))


# indicators

TRUE = "CASE WHEN n > 1 THEN greatest(h - l, abs(h - before), abs(l - before)) END"
DAYW = "OVER (PARTITION BY symbol, day ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
GAIN, LOSS = (f"avg(greatest({s}change, 0)) {last(14)}" for s in ("", "-"))
#: The deviation of the last 20 values of one, folded in order of time as a window in Spark does; the order of an engine's choosing differs in the last digit.
TWENTY = "(PARTITION BY symbol, one IS NULL ORDER BY ts_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_FOLD = "lambda x, y: {'k': x.k + 1, 'm': x.m + (y.m - x.m) / (x.k + 1), 's': x.s + (y.m - x.m) * ((y.m - x.m) - (y.m - x.m) / (x.k + 1))}"
DEVIATION = f"sqrt(list_reduce(list_transform(list(one) OVER {TWENTY}, lambda r: {{'k': 1::DOUBLE, 'm': r, 's': 0::DOUBLE}}), {_FOLD}).s / 20)"
IND = f"""{BASICS}, d AS (SELECT *, row_number() {DAYW} AS dn, CASE WHEN before <> 0 THEN change / before * 100 END AS one FROM b),
d20 AS (SELECT *, CASE WHEN one IS NOT NULL AND count(one) OVER {TWENTY} = 20 THEN {DEVIATION} END AS deviation FROM d), i AS (SELECT symbol, ts_ms, n, day, o, h, l, c, v,
 CASE WHEN n <= 14 THEN 50 WHEN {LOSS} = 0 THEN 100 ELSE 100 - 100 / (1 + {GAIN} / {LOSS}) END AS rsi,
 CASE WHEN n >= 20 THEN avg(c) {last(20)} + 2 * stddev_pop(c) {last(20)} ELSE 0 END AS bb_upper,
 CASE WHEN n >= 20 THEN avg(c) {last(20)} ELSE 0 END AS bb_mid,
 CASE WHEN n >= 20 THEN avg(c) {last(20)} - 2 * stddev_pop(c) {last(20)} ELSE 0 END AS bb_lower,
 coalesce(avg({TRUE}) {last(14)}, 0) AS atr,
 CASE WHEN n < 14 OR max(h) {last(14)} = min(l) {last(14)} THEN 50 ELSE (c - min(l) {last(14)}) / (max(h) {last(14)} - min(l) {last(14)}) * 100 END AS stoch,
 min(l) {last(20)} AS support, max(h) {last(20)} AS resistance,
 CASE WHEN sum(v) {DAYW} > 0 THEN sum((h + l + c) / 3 * v) {DAYW} / sum(v) {DAYW} ELSE avg(c) {DAYW} END AS vwap,
 max(CASE WHEN dn <= 3 THEN h END) {DAYW} AS or_high, min(CASE WHEN dn <= 3 THEN l END) {DAYW} AS or_low, dn > 3 AS or_ready,
 CASE WHEN n > 5 AND lag(c, 5) OVER w <> 0 THEN (c / lag(c, 5) OVER w - 1) * 100 ELSE 0 END AS ret_5, CASE WHEN n > 20 AND lag(c, 20) OVER w <> 0 THEN (c / lag(c, 20) OVER w - 1) * 100 ELSE 0 END AS ret_20,
 coalesce(last_value(deviation IGNORE NULLS) OVER w, 0) AS vol_20
 FROM d20 WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))"""


def _columns(*names):
    def run(spark, d):
        return rounded(indicators.with_indicators(bars(spark, d)).select("symbol", "ts_ms", *names))

    sql = f"WITH {IND} SELECT symbol, ts_ms, " + ", ".join(c if c == "or_ready" else f"{six(c)} AS {c}" for c in names) + " FROM i"
    return run, sql


for _name, _cols in {
    "c2_rsi": ("rsi",), "c4_bollinger": ("bb_upper", "bb_mid", "bb_lower"), "c5_atr": ("atr",), "c6_stochastic": ("stoch",),
    "c7_support_resistance": ("support", "resistance"), "c9_session_vwap": ("vwap", "or_high", "or_low", "or_ready"), "c20_returns": ("ret_5", "ret_20", "vol_20"),
}.items():
    QUERIES[_name], ORACLE[_name] = _columns(*_cols)


def same(a: str, *others: str) -> str:
    """SQL that joins others to a by place in the series, one without a symbol being a series too."""
    return " ".join(f"JOIN {o} ON {o}.symbol IS NOT DISTINCT FROM {a}.symbol AND {o}.n = {a}.n" for o in others)


def _recursive(period: int, source: str, value: str, name: str) -> str:
    k = 2.0 / (period + 1)
    return f"{name} AS (SELECT symbol, n, CAST({value} AS DOUBLE) AS y FROM {source} WHERE n = 1 UNION ALL SELECT s.symbol, s.n, e.y * (1 - {k!r}) + s.{value} * {k!r} FROM {name} e JOIN {source} s ON s.symbol IS NOT DISTINCT FROM e.symbol AND s.n = e.n + 1)"


@query(f"WITH RECURSIVE {BASICS}, {_recursive(20, 'b', 'c', 'e')} SELECT b.symbol, b.ts_ms, round(e.y, 6) AS ema_20 FROM b {same('b', 'e')}")
def c1_ema(spark, d):
    return rounded(ema(bars(spark, d), "c", 20, "ema_20").select("symbol", "ts_ms", "ema_20"))


@query(f"""WITH RECURSIVE {BASICS}, {_recursive(12, 'b', 'c', 'f')}, {_recursive(26, 'b', 'c', 's')},
m AS (SELECT f.symbol, f.n, f.y - s.y AS line FROM f {same('f', 's')}), {_recursive(9, 'm', 'line', 'g')}
SELECT b.symbol, b.ts_ms, round(line, 4) AS line, round(g.y, 4) AS signal FROM b {same('b', 'm', 'g')}""")
def c3_macd(spark, d):
    """The history form, which does not round the line before its average."""
    b = ema(ema(bars(spark, d), "c", 12, "fast"), "c", 26, "slow").withColumn("line", F.col("fast") - F.col("slow"))
    return rounded(ema(b, "line", 9, "signal").select("symbol", "ts_ms", "line", "signal"), 4)


@query(f"""WITH {BARS}, t AS (SELECT *, v > 0 AS traded, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts_ms) AS k FROM bars),
r AS (SELECT *, CASE WHEN traded AND k >= 5 THEN avg(v) OVER (PARTITION BY symbol, traded ORDER BY ts_ms ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(v) OVER (PARTITION BY symbol, traded ORDER BY ts_ms) END AS own FROM t),
q AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ms), 1) AS liq_ratio FROM r)
SELECT symbol, ts_ms, round(liq_ratio, 6) AS liq_ratio, CASE WHEN k < 5 THEN 'Unknown' WHEN liq_ratio >= 1.25 THEN 'High' WHEN liq_ratio <= 0.75 THEN 'Low' ELSE 'Normal' END AS liq_label FROM q""")
def c8_liquidity(spark, d):
    return rounded(indicators.liquidity(bars(spark, d)).select("symbol", "ts_ms", "liq_ratio", "liq_label"))


@query(f"WITH {BASICS} SELECT symbol, day, min(v) > 2 AS fully_volumed, count(*) AS n FROM b GROUP BY symbol, day")
def c12_volumed_sessions(spark, d):
    """Days on which every bar has more than two ticks."""
    return indicators.with_basics(bars(spark, d)).groupBy("symbol", "day").agg(F.every(F.col("v") > 2).alias("fully_volumed"), F.count("*").alias("n"))


@query(f"WITH {BASICS}, z AS (SELECT symbol, day, last(c ORDER BY ts_ms) AS lc FROM b GROUP BY symbol, day), p AS (SELECT symbol, day, lag(lc) OVER (PARTITION BY symbol ORDER BY day) AS pc FROM z) SELECT b.symbol, b.ts_ms, round(pc, 6) AS prev_close, round(CASE WHEN pc <> 0 THEN (c - pc) / pc * 100 ELSE 0 END, 6) AS day_change FROM b JOIN p ON p.symbol IS NOT DISTINCT FROM b.symbol AND p.day = b.day")
def c16_previous_close(spark, d):
    return rounded(indicators.previous_close(bars(spark, d)).select("symbol", "ts_ms", "prev_close", "day_change"))


ARMS = "PARTITION BY symbol, day ORDER BY ts_ms ROWS BETWEEN"


@query(f"""WITH {BASICS}, s AS (SELECT symbol, ts_ms, count(*) OVER p = 2 AND count(*) OVER q = 2 AND h >= max(h) OVER p AND h > max(h) OVER q AS swing_high,
 count(*) OVER p = 2 AND count(*) OVER q = 2 AND l <= min(l) OVER p AND l < min(l) OVER q AS swing_low FROM b WINDOW p AS ({ARMS} 2 PRECEDING AND 1 PRECEDING), q AS ({ARMS} 1 FOLLOWING AND 2 FOLLOWING))
SELECT symbol, ts_ms, swing_high, swing_low FROM s WHERE swing_high OR swing_low""")
def c17_swings(spark, d):
    return indicators.swings(bars(spark, d)).where("swing_high or swing_low").select("symbol", "ts_ms", "swing_high", "swing_low")


@query(f"""WITH {BASICS}, t AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN n = 2 OR (change > 0) <> (lag(change > 0) OVER w) THEN 1 ELSE 0 END ELSE 0 END AS turn FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
g AS (SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY ts_ms) AS island FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, island ORDER BY ts_ms) AS k FROM g)
SELECT symbol, ts_ms, CAST(CASE WHEN n = 1 THEN 0 WHEN change > 0 THEN least(k, 20) ELSE -least(k, 20) END AS INT) AS streak FROM r""")
def c19_streak(spark, d):
    return indicators.streaks(bars(spark, d)).select("symbol", "ts_ms", F.col("streak").cast("int").alias("streak"))


@query(f"""WITH {BASICS}, w AS (SELECT symbol, n AS mid, c, lag(h) OVER k AS h0, lag(l) OVER k AS l0, lead(h) OVER k AS h2, lead(l) OVER k AS l2 FROM b WINDOW k AS (PARTITION BY symbol ORDER BY ts_ms)),
z AS (SELECT symbol, mid, 'bull' AS side, h0 AS low, l2 AS high, c FROM w UNION ALL SELECT symbol, mid, 'bear', h2, l0, c FROM w), y AS (SELECT * FROM z WHERE high - low >= c * 0.0003)
SELECT y.symbol, CAST(mid AS INT) AS n, side, round(low, 6) AS low, round(high, 6) AS high, CAST((SELECT min(b.n) FROM b WHERE b.symbol = y.symbol AND b.n BETWEEN mid + 2 AND mid + 80 AND CASE WHEN side = 'bull' THEN b.l <= y.low ELSE b.h >= y.high END) AS INT) AS filled_n FROM y""")
def c14_gap_zones(spark, d):
    return rounded(indicators.gap_zones(bars(spark, d)))


# signals, grading, economics

READINGS = f"""{IND}, k AS (SELECT *, CASE WHEN rsi < 35 OR (bb_lower > 0 AND c <= bb_lower * 1.002) THEN 'BUY' WHEN rsi > 65 OR (bb_upper > 0 AND c >= bb_upper * 0.998) THEN 'SELL' END AS action FROM i),
readings AS (SELECT symbol, ts_ms, action, c AS entry, CASE action WHEN 'BUY' THEN c * (1 + 1.5 / 100) ELSE c * (1 - 1.5 / 100) END AS target, CASE action WHEN 'BUY' THEN c * (1 - 0.8 / 100) ELSE c * (1 + 0.8 / 100) END AS stop,
 abs(rsi - 50) AS confidence, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) AS r FROM k WHERE action IS NOT NULL)"""
MERGED = READINGS + """, m AS (SELECT symbol, r, action, ts_ms AS first_ms, ts_ms, 1 AS updates, confidence, confidence AS peak, entry, target, stop, 1 AS id FROM readings WHERE r = 1
UNION ALL SELECT m.symbol, x.r, x.action, CASE WHEN app THEN x.ts_ms ELSE m.first_ms END, CASE WHEN app OR upd THEN x.ts_ms ELSE m.ts_ms END,
 CASE WHEN app THEN 1 WHEN upd THEN m.updates + 1 ELSE m.updates END, CASE WHEN app OR upd THEN x.confidence ELSE m.confidence END,
 CASE WHEN app THEN x.confidence WHEN upd THEN greatest(m.peak, x.confidence) ELSE m.peak END, CASE WHEN app OR upd THEN x.entry ELSE m.entry END,
 CASE WHEN app OR upd THEN x.target ELSE m.target END, CASE WHEN app OR upd THEN x.stop ELSE m.stop END, CASE WHEN app THEN m.id + 1 ELSE m.id END
 FROM m JOIN (SELECT *, NULL FROM readings) x ON x.symbol = m.symbol AND x.r = m.r + 1, LATERAL (SELECT x.action <> m.action OR x.ts_ms - m.ts_ms > 1200000 AS app) p, LATERAL (SELECT NOT app AND x.confidence <> m.confidence AS upd) q),
merged AS (SELECT symbol, action, first_ms, max(ts_ms) AS ts_ms, max(updates) AS updates, last(confidence ORDER BY r) AS confidence, max(peak) AS peak, last(entry ORDER BY r) AS entry, last(target ORDER BY r) AS target, last(stop ORDER BY r) AS stop FROM m GROUP BY symbol, action, first_ms)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return signals.merge_signals(signals.band_signals(indicators.with_indicators(bars(spark, d))))


@query(f"WITH RECURSIVE {MERGED} SELECT symbol, action, first_ms, ts_ms, updates, {ROUND('confidence', 'peak', 'entry', 'target', 'stop')} FROM merged")
def g12_signal_merge(spark, d):
    return rounded(_merged(spark, d))


def graded_sql(window: int = 86400000) -> str:
    buy = "s.action = 'BUY'"
    return f"""s AS (SELECT *, CAST(first_ms AS VARCHAR) || symbol AS sid, CASE WHEN action = 'BUY' THEN greatest(target, entry + 0.5) ELSE least(target, entry - 0.5) END AS goal FROM merged),
p AS (SELECT s.sid, b.ts_ms AS tm, b.h, b.l, b.c, s.action, s.entry, CASE WHEN {buy} THEN b.h >= goal ELSE b.l <= goal END AS g, CASE WHEN {buy} THEN b.l <= stop ELSE b.h >= stop END AS x
 FROM s JOIN bars b ON b.symbol = s.symbol AND b.ts_ms BETWEEN s.first_ms AND s.first_ms + {window}),
f AS (SELECT sid, min(CASE WHEN g OR x THEN tm END) AS first FROM p GROUP BY sid),
q AS (SELECT p.sid, any_value(first) AS first, last(x ORDER BY tm) AS stopped, last(c ORDER BY tm) AS lc, greatest(max(CASE WHEN action = 'BUY' THEN h - entry ELSE entry - l END), 0) AS mfe, least(min(CASE WHEN action = 'BUY' THEN l - entry ELSE entry - h END), 0) AS mae
 FROM p JOIN f ON f.sid = p.sid WHERE first IS NULL OR tm <= first GROUP BY p.sid),
graded AS (SELECT s.*, CASE WHEN first IS NULL THEN 'expired' WHEN stopped THEN 'stop' ELSE 'target' END AS status, CASE WHEN first IS NULL THEN coalesce(lc, entry) WHEN stopped THEN stop ELSE goal END AS resolved_price, coalesce(mfe, 0) AS mfe, coalesce(mae, 0) AS mae FROM s LEFT JOIN q ON q.sid = s.sid)"""


def _graded(spark: SparkSession, d: str, window: int = 86_400_000) -> DataFrame:
    s = _merged(spark, d).withColumn("sid", F.concat(F.col("first_ms").cast("string"), "symbol")).withColumn("stored_ms", F.col("ts_ms")).withColumn("ts_ms", F.col("first_ms"))
    return grading.grade(s, bars(spark, d), window, min_points=0.5)


@query(f"WITH RECURSIVE {MERGED}, {graded_sql()} SELECT symbol, first_ms, action, status, {ROUND('resolved_price', 'mfe', 'mae')} FROM graded")
def d5_first_touch_grading(spark, d):
    return rounded(_graded(spark, d).select("symbol", "first_ms", "action", "status", "resolved_price", "mfe", "mae"))


@query(f"WITH RECURSIVE {MERGED}, {graded_sql()} SELECT symbol, count(*) AS total, count(*) FILTER (status = 'target') AS passed, count(*) FILTER (status = 'stop') AS failed, count(*) FILTER (status = 'expired') AS expired, round(count(*) FILTER (status = 'target') / nullif(count(*) FILTER (status <> 'expired'), 0) * 100, 4) AS win_pct FROM graded GROUP BY symbol")
def e12_outcome_summary(spark, d):
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return _graded(spark, d).groupBy("symbol").agg(F.count("*").alias("total"), n("target").alias("passed"), n("stop").alias("failed"), n("expired").alias("expired"), F.round(F.try_divide(n("target"), n("target") + n("stop")) * 100, 4).alias("win_pct"))


def economics_sql(by: str, settled: str, cost: float = 0.1) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY first_ms, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""t AS (SELECT *, (resolved_price - entry) * CASE action WHEN 'BUY' THEN 1 ELSE -1 END AS gross FROM graded WHERE status IN ({settled})),
u AS (SELECT *, gross - {cost} AS net, sum(gross - {cost}) {w} AS equity FROM t), x AS (SELECT *, greatest(max(equity) {w}, 0) - equity AS dip FROM u)
SELECT {by}, count(*) AS resolved, round(avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0 END) * 100, 4) AS win_pct, round(avg(gross), 4) AS gross_pts, round(avg(net), 4) AS net_pts, round(sum(net), 4) AS total_net,
 round(CASE WHEN abs(sum(CASE WHEN gross <= 0 THEN gross END)) > 0 THEN coalesce(sum(CASE WHEN gross > 0 THEN gross END), 0) / abs(sum(CASE WHEN gross <= 0 THEN gross END)) END, 2) AS profit_factor, round(greatest(max(dip), 0), 4) AS max_drawdown FROM x GROUP BY {by}"""


@query(f"WITH RECURSIVE {MERGED}, {graded_sql()}, " + economics_sql("symbol", "'target', 'stop'"))
def e13_trade_economics(spark, d):
    """The flagship: signals of each symbol, merged, graded within a day, and their economics after costs."""
    return grading.summarize(_graded(spark, d), ["symbol"], 0.1)


@query(f"WITH RECURSIVE {MERGED}, {graded_sql()}, " + economics_sql("action", "'target', 'stop', 'expired'"))
def e13_by_action_counting_expired(spark, d):
    return grading.summarize(_graded(spark, d), ["action"], 0.1, True)


WINDOWS = (("30m", 1_800_000), ("1h", 3_600_000), ("4h", 14_400_000), ("24h", 86_400_000))


@query(" UNION ALL ".join(f"SELECT '{k}' AS hold, * FROM (WITH RECURSIVE {MERGED}, {graded_sql(w)} SELECT status, count(*) AS n, round(sum((resolved_price - entry) * CASE action WHEN 'BUY' THEN 1 ELSE -1 END), 4) AS gross FROM graded GROUP BY status)" for k, w in WINDOWS))
def g18_time_exits(spark, d):
    """The same signals graded at several holding times."""
    sign = F.when(F.col("action") == "BUY", 1).otherwise(-1)
    out = None
    for name, w in WINDOWS:
        g = _graded(spark, d, w).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum((F.col("resolved_price") - F.col("entry")) * sign), 4).alias("gross")).withColumn("hold", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


COST = "WITH t AS (SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice / 100 AS b, l_extendedprice * (1 + l_tax - l_discount) / 100 AS s FROM lineitem)"


@query(COST + """ SELECT id, line, round(40 + s * 75 * 0.001 + (b + s) * 75 * 0.0003503 + (b + s) * 75 * 0.000001 + b * 75 * 0.00003 + (40 + (b + s) * 75 * 0.0003503 + (b + s) * 75 * 0.000001) * 0.18 + 0.05 * 75 * 2, 4) AS option_cost,
 round(least(b * 0.0003, 20) + least(s * 0.0003, 20) + s * 0.00025 + (b + s) * 0.0000297 + (b + s) * 0.000001 + b * 0.00003 + (least(b * 0.0003, 20) + least(s * 0.0003, 20) + (b + s) * 0.0000297 + (b + s) * 0.000001) * 0.18 + (b + s) * 0.0005, 4) AS intraday_cost FROM t""")
def e16_trade_costs(spark, d):
    t = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_extendedprice") / 100).alias("b"), (F.col("l_extendedprice") * (1 + F.col("l_tax") - F.col("l_discount")) / 100).alias("s"))
    return t.select("id", "line", F.round(m.option_buy_cost(F.col("b"), F.col("s")), 4).alias("option_cost"), F.round(m.intraday_cost(F.col("b"), F.col("s")), 4).alias("intraday_cost"))


# research

TESTS = f"""{DAILY}, a AS (SELECT *, lag(c) OVER w AS pc FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY day)),
r AS (SELECT *, CASE WHEN pc IS NOT NULL THEN CASE WHEN pc <> 0 THEN (c - pc) / pc * 100 ELSE 0 END END AS ret, CASE WHEN pc <> 0 THEN (o - pc) / pc * 100 ELSE 0 END AS night, CASE WHEN o <> 0 THEN (c - o) / o * 100 ELSE 0 END AS oc FROM a),
z AS (SELECT *, lag(ret) OVER w AS p1, lag(ret, 2) OVER w AS p2, lag(ret, 3) OVER w AS p3 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day)), y AS (SELECT * FROM z WHERE pc IS NOT NULL),
x AS (SELECT symbol, 'overnight' AS test, '' AS base, night AS value FROM y UNION ALL SELECT symbol, 'intraday', '', oc FROM y WHERE o <> 0 UNION ALL SELECT symbol, 'full_day', '', ret FROM y
 UNION ALL SELECT symbol, 'overnight_' || (year(day) - year(day) % 4), '', night FROM y UNION ALL SELECT symbol, CASE WHEN night >= 0.3 THEN 'gap_up' WHEN night <= -0.3 THEN 'gap_down' ELSE 'gap_none' END, 'all_gaps', oc FROM y
 UNION ALL SELECT symbol, 'all_gaps', '', oc FROM y UNION ALL SELECT symbol, 'weekday_' || (isodow(day) - 1), 'full_day', ret FROM y WHERE isodow(day) <= 5 UNION ALL SELECT symbol, 'month_' || month(day), 'full_day', ret FROM y
 UNION ALL SELECT symbol, 'after_down', 'full_day', ret FROM y WHERE p1 <= -1 UNION ALL SELECT symbol, 'after_up', 'full_day', ret FROM y WHERE p1 >= 1
 UNION ALL SELECT symbol, 'after_down_streak', 'full_day', ret FROM y WHERE p1 < 0 AND p2 < 0 AND p3 < 0 UNION ALL SELECT symbol, 'after_up_streak', 'full_day', ret FROM y WHERE p1 > 0 AND p2 > 0 AND p3 > 0),
s AS (SELECT symbol, test, base, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd FROM x GROUP BY 1, 2, 3),
k AS (SELECT s.symbol, s.test, s.n, s.mean, s.sd, coalesce(q.mean, 0) AS base_mean FROM s LEFT JOIN s q ON q.symbol = s.symbol AND q.test = s.base)"""


@query(f"WITH {TESTS} SELECT symbol, test, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(base_mean, 4) AS base_mean, round(CASE WHEN n < 2 OR sd = 0 THEN 0 ELSE (mean - base_mean) / (sd / sqrt(n)) END, 4) AS t FROM k")
def e1_mean_tests(spark, d):
    """Overnight, intraday, period, gap, weekday, month, reversion and streak effects."""
    return rounded(research.findings(research.hypotheses(daily(spark, d))), 4)


@query(f"WITH {DAILY}, a AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY day) AS pc FROM daily), g AS (SELECT *, CASE WHEN (o - pc) / pc * 100 >= 0.3 THEN 'up' WHEN (o - pc) / pc * 100 <= -0.3 THEN 'down' END AS side FROM a WHERE pc IS NOT NULL), f AS (SELECT symbol, side, count(*) AS n, count(*) FILTER (CASE side WHEN 'up' THEN l <= pc ELSE h >= pc END) AS filled FROM g WHERE side IS NOT NULL GROUP BY 1, 2) SELECT symbol, side, n, filled, round(filled / n, 6) AS rate, round((filled / n - 0.5) / sqrt(0.25 / n), 6) AS z FROM f")
def e7_gap_fill(spark, d):
    return rounded(research.gap_fills(daily(spark, d)))


@query(f"WITH {BASICS}, q AS (SELECT symbol, CAST(floor(((ts_ms + 19800000) % 86400000) / 60000) AS INT) AS minute, (c - o) / o * 100 AS r FROM b WHERE o > 0), a AS (SELECT symbol, avg(r) AS base FROM q GROUP BY symbol) SELECT q.symbol, minute, count(*) AS n, round(avg(r), 6) AS mean, round(any_value(base), 6) AS base FROM q JOIN a ON a.symbol = q.symbol GROUP BY 1, 2 HAVING count(*) >= 10")
def e9_time_of_day(spark, d):
    b = bars(spark, d).where("o > 0").select("symbol", m.day_minutes(F.col("ts_ms")).alias("minute"), m.percent(F.col("c"), F.col("o")).alias("r"))
    slots = b.groupBy("symbol", "minute").agg(F.count("*").alias("n"), F.sum("r").alias("s"))
    base = slots.groupBy("symbol").agg((F.sum("s") / F.sum("n")).alias("base"))
    return rounded(slots.where("n >= 10").join(F.broadcast(base), "symbol").select("symbol", "minute", "n", (F.col("s") / F.col("n")).alias("mean"), "base"))


@query(f"""WITH {BASICS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts_ms) AS k FROM b), r AS (SELECT symbol, day, max(h) AS hi, min(l) AS lo FROM k WHERE k <= 3 GROUP BY 1, 2),
g AS (SELECT k.symbol, k.day, count(*) AS n, any_value(hi) AS hi, any_value(lo) AS lo, last(c ORDER BY ts_ms) AS close, min(CASE WHEN k > 3 AND h > hi THEN ts_ms END) AS up, min(CASE WHEN k > 3 AND l < lo THEN ts_ms END) AS down FROM k JOIN r ON r.symbol = k.symbol AND r.day = k.day GROUP BY 1, 2)
SELECT symbol, day, CASE WHEN up IS NOT NULL AND (down IS NULL OR up <= down) THEN 'up' ELSE 'down' END AS side, round(CASE WHEN up IS NOT NULL AND (down IS NULL OR up <= down) THEN (close - hi) / hi * 100 ELSE (lo - close) / close * 100 END, 6) AS ret FROM g WHERE n >= 8 AND (up IS NOT NULL OR down IS NOT NULL)""")
def e11_opening_breakouts(spark, d):
    return rounded(research.opening_breakouts(indicators.with_basics(bars(spark, d))))


@query(f"""WITH {TESTS}, f AS (SELECT *, CASE WHEN n < 2 OR sd = 0 THEN 0 ELSE (mean - base_mean) / (sd / sqrt(n)) END AS t FROM k), p AS (SELECT *, 2 * (1 - {phi('abs(t)')}) AS p, 0.05 / greatest(count(*) OVER (), 1) AS bar FROM f)
SELECT symbol, test, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(base_mean, 4) AS base_mean, round(t, 4) AS t, round(mean - 1.96 * sd / sqrt(n), 4) AS ci_low, round(mean + 1.96 * sd / sqrt(n), 4) AS ci_high, n < 30 AS few, round(p, 6) AS p, round(bar, 8) AS bar, p < bar AND n >= 30 AS survives FROM p""")
def e3_bonferroni(spark, d):
    """p-values, 95 % intervals, cases too few to judge, and survivors of every test."""
    found = research.with_p_values(research.findings(research.hypotheses(daily(spark, d))))
    half = F.col("sd") * 1.96 / F.sqrt("n")
    values = {c: F.round(c, 4) for c in ("mean", "sd", "base_mean", "t")} | {"ci_low": F.round(F.col("mean") - half, 4), "ci_high": F.round(F.col("mean") + half, 4), "few": F.col("n") < 30, "p": F.round("p", 6), "bar": F.round("bar", 8)}
    return found.select("symbol", "test", "n", *(v.alias(c) for c, v in values.items()), "survives")


# regimes, filter, funds


@query(f"""WITH {VIX}, a AS (SELECT *, row_number() OVER (ORDER BY day) AS k, lag(close) OVER (ORDER BY day) AS level, avg(close) OVER (ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m FROM vix)
SELECT a.day, round(level, 6) AS level, round(level / m, 6) AS ratio, round((SELECT count(*) FILTER (p.close < a.level) / count(*) FROM a p WHERE p.k BETWEEN a.k - 252 AND a.k - 1), 6) AS rank FROM a WHERE level IS NOT NULL""")
def d3_regime_context(spark, d):
    return rounded(regime.context(volatility(spark, d)))


TRADES = "trades AS (SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_shipdate AS DATE) AS day, l_tax * 100 - l_discount * 100 AS pts, l_quantity + l_linenumber / 10.0 AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_linestatus AS pool FROM lineitem)"


def _trades(spark: SparkSession, d: str) -> DataFrame:
    """Scored trades of the line items."""
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("day"), (F.col("l_tax") * 100 - F.col("l_discount") * 100).alias("pts"),
        (F.col("l_quantity") + F.col("l_linenumber") / 10.0).alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), F.col("l_linestatus").alias("pool"),
    )


@query(f"WITH {VIX}, {TRADES}, p AS (SELECT day, lag(close) OVER (ORDER BY day) AS vix FROM vix) SELECT id, line, round(vix, 6) AS vix FROM trades LEFT JOIN p ON p.day = trades.day")
def d2_previous_close_vix(spark, d):
    return rounded(regime.with_previous_close(_trades(spark, d), volatility(spark, d)).select("id", "line", "vix"))


@query(f"""WITH {VIX}, {TRADES}, p AS (SELECT day, lag(close) OVER (ORDER BY day) AS vix FROM vix), j AS (SELECT pts, CASE WHEN vix >= 25 THEN 4 WHEN vix >= 18 THEN 3 WHEN vix >= 14 THEN 2 WHEN vix >= 12 THEN 1 WHEN vix >= 0 THEN 0 END AS band FROM trades JOIN p ON p.day = trades.day WHERE vix IS NOT NULL)
SELECT CAST(g AS INT) AS band, count(pts) AS trades, round(count(pts) / (SELECT count(*) FROM j) * 100, 6) AS share_pct, round(avg(CASE WHEN pts > 0 THEN 1.0 WHEN pts <= 0 THEN 0 END) * 100, 6) AS win_pct, round(avg(pts), 6) AS mean_pts FROM range(5) t(g) LEFT JOIN j ON j.band = g GROUP BY g""")
def e17_regime_table(spark, d):
    return regime.by_band(regime.with_previous_close(_trades(spark, d), volatility(spark, d)))


@query(f"""WITH {TRADES}, r AS (SELECT pool, label, rank() OVER (PARTITION BY pool ORDER BY score) + (count(*) OVER (PARTITION BY pool, score) - 1) / 2.0 AS k FROM trades)
SELECT pool, round((sum(CASE WHEN label = 1 THEN k END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r GROUP BY pool""")
def e21_auc(spark, d):
    return rounded(regime.auc(_trades(spark, d), ["pool"]))


@query(f"""WITH {TRADES}, k AS (SELECT f, (SELECT s FROM (SELECT score AS s, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM trades) WHERE i = CAST(ceil((1 - f) * n) AS BIGINT)) AS threshold FROM (VALUES (0.5::DOUBLE), (0.4::DOUBLE), (0.3::DOUBLE), (0.2::DOUBLE), (0.1::DOUBLE)) v(f))
SELECT f AS keep, threshold, count(*) AS trades, round(avg(CASE WHEN pts > 0 THEN 1.0 ELSE 0 END) * 100, 6) AS win_pct, round(avg(pts), 6) AS net FROM k JOIN trades ON score >= threshold GROUP BY f, threshold""")
def e22_keep_fractions(spark, d):
    return regime.keep_economics(_trades(spark, d))


@query(f"""WITH {TRADES}, i AS (SELECT id, line, pool, row_number() OVER (PARTITION BY pool ORDER BY day, id, line) - 1 AS i, count(*) OVER (PARTITION BY pool) AS n FROM trades)
SELECT pool, fold, count(*) AS n, min(i) AS first FROM (SELECT *, CAST(CASE WHEN floor((n - 400) / 4) >= 20 AND i >= 400 THEN least(floor((i - 400) / floor((n - 400) / 4)), 3) END AS INT) AS fold FROM i) GROUP BY pool, fold""")
def f21_folds(spark, d):
    f = regime.folds(_trades(spark, d), ["pool"], ["day", "id", "line"])
    return regime.numbered(f, ["pool"], ["day", "id", "line"]).drop("n").groupBy("pool", "fold").agg(F.count("*").alias("n"), F.min("i").cast("long").alias("first"))


@query(f"""WITH {DAILY}, p AS (SELECT a.symbol || b.symbol AS fund, a.day, a.c AS f, b.c AS x FROM daily a JOIN daily b ON a.day = b.day AND a.symbol <> b.symbol WHERE a.c > 0 AND b.c > 0), k AS (SELECT *, f / x AS r, row_number() OVER (PARTITION BY fund ORDER BY day DESC) AS k FROM p),
g AS (SELECT fund, count(*) AS n, median(r) AS ratio, last(f ORDER BY day) AS close, last(x ORDER BY day) AS idx FROM k WHERE k <= 20 GROUP BY fund), h AS (SELECT k.fund, median(abs(r - ratio) / ratio) * 100 AS mad FROM k JOIN g ON g.fund = k.fund WHERE k <= 20 GROUP BY k.fund)
SELECT g.fund, n, round(ratio, 6) AS ratio, round(mad, 6) AS mad_pct, mad <= 1 AS stable, round(ratio * idx, 4) AS fair, round((close / (ratio * idx) - 1) * 100, 4) AS premium_pct FROM g JOIN h ON h.fund = g.fund WHERE n >= 8""")
def e20_fund_premium(spark, d):
    """Each pair of symbols as fund and index, aligned on days both traded."""
    a = daily(spark, d).select("day", F.col("symbol").alias("a"), F.col("c").alias("fund_close"))
    b = daily(spark, d).select("day", F.col("symbol").alias("b"), F.col("c").alias("index_close"))
    t = regime.tracking(a.join(b, "day").where("a <> b").withColumn("fund", F.concat("a", "b")))
    return t.select("fund", "n", F.round("ratio", 6).alias("ratio"), F.round("mad_pct", 6).alias("mad_pct"), "stable", F.round("fair", 4).alias("fair"), F.round("premium_pct", 4).alias("premium_pct"))
