"""Registered queries of landing files, symbols, holdings, watch lists, headlines of an asset and paper books, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.functions import market as m
from candlemill.functions.scan import ema
from candlemill.operators import grading, holdings, indicators, signals, trend
from candlemill.operators.decisions import half_up
from candlemill.plans.calls import HEAD
from candlemill.plans.market import BASICS, COST, IND, MERGED, TRADES, _recursive, _trades, graded_sql, query, rounded, same
from candlemill.sources import archive
from candlemill.sources.testdata import BARS, DAILY, MS, bars, daily, epoch_ms, load

# archive and landing


@query(f"WITH {BARS} SELECT symbol, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM bars WHERE symbol = 'click' GROUP BY symbol")
def a4_coverage(spark, d):
    return archive.inventory(archive.read_range(bars(spark, d), "click"))


@query("""SELECT event_type AS symbol, epoch_us(ts) // 1000000 * 1000 AS ts_ms, round(CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END, 2) AS o, round(value + 1, 2) AS h, round(value - 1, 2) AS l, round(value, 2) AS c, CAST(floor(event_id % 7 + 0.5) AS BIGINT) AS v
FROM events WHERE event_id % 11 <> 0 AND round(value, 2) > 0""")
def a7_chart_landing(spark, d):
    """Chart bodies, one a symbol and hour, whose arrays are matched by position; some prices are missing."""
    e = load(spark, d, "events").withColumn("sec", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"))
    at = F.struct("sec", "event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("o"), (F.col("value") + 1).alias("h"), (F.col("value") - 1).alias("l"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("c"), (F.col("event_id") % 7 + 0.5).alias("v"))
    rows = e.groupBy(F.col("event_type").alias("symbol"), F.expr("sec div 3600").alias("hour")).agg(F.array_sort(F.collect_list(at)).alias("x"))
    arrays = [F.col(f"x.{k}").alias(n) for n, k in zip(("timestamp", "open", "high", "low", "close", "volume"), ("sec", "o", "h", "l", "c", "v"))]
    return archive.clean_charts(rows.select("symbol", F.to_json(F.struct(*arrays)).alias("body")))


_CASE = lambda key, names: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
ASKED = """CASE c_custkey % 6 WHEN 0 THEN 'nifty ' WHEN 1 THEN 'BankNifty' WHEN 2 THEN 'dax' ELSE 'p' || c_custkey || CASE WHEN c_custkey % 6 = 3 THEN '.bo' ELSE '' END END"""


@query(f"""WITH s AS (SELECT c_custkey AS id, {ASKED} AS symbol, CASE WHEN c_custkey % 6 < 3 THEN 'INDEX' WHEN c_custkey % 6 < 5 THEN 'EQUITY' ELSE 'FUTURE' END AS segment FROM customer), u AS (SELECT *, upper(trim(symbol)) AS k FROM s)
SELECT id, CASE WHEN segment = 'INDEX' THEN coalesce({_CASE('k', holdings.CHART_INDEX)}, symbol) WHEN k LIKE '%.%' THEN k WHEN segment = 'EQUITY' THEN k || '.NS' ELSE k END AS chart,
 CASE WHEN segment = 'INDEX' THEN {_CASE('k', holdings.EXCHANGE_INDEX)} WHEN segment = 'EQUITY' THEN 'NSE:' || k || '-EQ' ELSE 'NSE:' || k END AS exchange FROM u""")
def a10_symbols(spark, d):
    s = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(ASKED).alias("symbol"), F.expr("CASE WHEN c_custkey % 6 < 3 THEN 'INDEX' WHEN c_custkey % 6 < 5 THEN 'EQUITY' ELSE 'FUTURE' END").alias("segment"))
    return s.select("id", holdings.chart_symbol(F.col("symbol"), F.col("segment")).alias("chart"), holdings.exchange_symbol(F.col("symbol"), F.col("segment")).alias("exchange"))


# scalars


@query(f"WITH t AS (SELECT event_id, {MS} + 19800000 AS ms FROM events) SELECT event_id, CAST(floor(ms / 86400000) AS INT) AS day, strftime(make_timestamp(ms * 1000), '%H:%M') AS label, CAST(floor((ms - floor(ms / 86400000) * 86400000) / 60000) AS INT) AS minutes, CAST(isodow(make_timestamp(ms * 1000)) - 1 AS INT) AS weekday FROM t")
def b1_calendar_keys(spark, d):
    """Day, clock label, minute of the day and weekday at +05:30."""
    e = load(spark, d, "events").select("event_id", epoch_ms("ts").alias("ms"))
    day, minutes = m.session_day(F.col("ms")), m.day_minutes(F.col("ms"))
    label = F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60)
    return e.select("event_id", day.alias("day"), label.alias("label"), minutes.alias("minutes"), F.pmod(day + 3, F.lit(7)).cast("int").alias("weekday"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, round(CASE WHEN l_discount <> 0 THEN (l_tax - l_discount) / l_discount * 100 ELSE 0 END, 6) AS pct FROM lineitem")
def b4_percent_change(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(m.percent(F.col("l_tax"), F.col("l_discount")), 6).alias("pct"))


@query("SELECT o_orderkey AS id, CAST(floor((o_orderkey % 11 - 5) / 2 + 0.5::DOUBLE) AS BIGINT) AS whole, least(90, greatest(20, o_orderkey % 120)) AS clamped, round(o_totalprice / 7, 3) AS digits FROM orders")
def b5_rounding(spark, d):
    """Halves go up, also below zero; values clamped to a range; a value at three digits."""
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(k.alias("id"), half_up((k % 11 - 5) / 2).alias("whole"), F.least(F.lit(90), F.greatest(F.lit(20), k % 120)).alias("clamped"), F.round(F.col("o_totalprice") / 7, 3).alias("digits"))


# holdings

LIVE, STORED = "CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN ' Other ' END", "CASE c_custkey % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN ' Energy ' END"


@query(f"""WITH s AS (SELECT c_custkey AS id, {LIVE} AS live, {STORED} AS stored, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0),
t AS (SELECT id, coalesce(CASE WHEN lower(trim(live)) NOT IN ('other', 'n/a') THEN trim(live) END, CASE WHEN lower(trim(stored)) NOT IN ('other', 'n/a') THEN trim(stored) END, n_name, 'Unsectored') AS sector FROM s) SELECT id, sector, sector = 'Unsectored' AS unknown FROM t""")
def b11_sectors(spark, d):
    """Sectors by live profile, stored entry, then a table (here the even nations' names)."""
    h = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("symbol"), F.expr(LIVE).alias("live_sector"), F.expr(STORED).alias("stored_sector"))
    t = load(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("symbol"), F.col("n_name").alias("table_sector"))
    return holdings.with_sector(h, t).select("id", "sector", "unknown")


@query("""WITH x AS (SELECT c_custkey AS id, c_nationkey AS portfolio, (c_acctbal - 4000) / 800 AS gain, c_custkey % 61 / 10.0 - 3 AS change FROM customer),
y AS (SELECT *, CASE WHEN gain <= -5 THEN 65 WHEN gain >= 1.5 THEN 70 WHEN gain <= -0.8 THEN 72 WHEN change >= 1.5 THEN 551 WHEN change <= -1.5 THEN 552 ELSE 45 END AS k FROM x),
z AS (SELECT *, CASE WHEN k IN (65, 552) THEN 'BUY' WHEN k IN (70, 72, 551) THEN 'SELL' ELSE 'HOLD' END AS action, CAST(CASE WHEN k > 100 THEN 55 ELSE k END AS INT) AS confidence FROM y)
SELECT id, portfolio, action, confidence, CAST(row_number() OVER (PARTITION BY portfolio ORDER BY CASE action WHEN 'BUY' THEN 0 WHEN 'SELL' THEN 1 ELSE 2 END, confidence DESC, id) AS INT) AS place FROM z""")
def h2_ranked_holding_calls(spark, d):
    """Each holding's call (B13), and its place in the portfolio's list."""
    h = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("portfolio"), ((F.col("c_acctbal") - 4000) / 800).alias("gain"), (F.col("c_custkey") % 61 / 10.0 - 3).alias("change"))
    h = h.withColumn("x", holdings.holding_call(F.col("gain"), F.col("change"))).select("id", "portfolio", "x.*")
    return holdings.ranked(h, ["portfolio"], "id")


@query(f"""WITH {BASICS}, z AS (SELECT symbol, day, last(c ORDER BY ts_ms) AS lc FROM b GROUP BY symbol, day), p AS (SELECT symbol, day, lag(lc) OVER (PARTITION BY symbol ORDER BY day) AS pc FROM z), x AS (SELECT b.symbol, ts_ms, CASE WHEN pc <> 0 THEN (c - pc) / pc * 100 ELSE 0 END AS g FROM b JOIN p ON p.symbol IS NOT DISTINCT FROM b.symbol AND p.day = b.day)
SELECT symbol, ts_ms, CASE WHEN g >= 2 THEN 'SELL' WHEN g <= -2 THEN 'BUY' WHEN g >= 0.8 THEN 'HOLD' WHEN g <= -0.8 THEN 'BUY' ELSE 'HOLD' END AS action, CASE WHEN abs(g) >= 2 THEN 58 WHEN g >= 0.8 THEN 45 WHEN g <= -0.8 THEN 50 ELSE 40 END AS confidence FROM x""")
def b13_watch_calls(spark, d):
    b = indicators.previous_close(bars(spark, d)).withColumn("x", holdings.watch_call(F.col("day_change"), F.col("c")))
    return b.select("symbol", "ts_ms", "x.*")


@query(f"""WITH RECURSIVE {IND}, {', '.join(_recursive(k, 'i', 'c', f'e{k}') for k in (12, 20, 26, 50))}, mm AS (SELECT e12.symbol, e12.n, e12.y - e26.y AS line FROM e12 {same('e12', 'e26')}), {_recursive(9, 'mm', 'line', 'e9')},
x AS (SELECT i.*, line - e9.y AS hist, e20.y AS y20, e50.y AS y50 FROM i {same('i', 'mm', 'e9', 'e20', 'e50')} WHERE i.n >= 50),
p AS (SELECT symbol, ts_ms, CASE WHEN rsi < 30 THEN 4 WHEN rsi < 40 THEN 1 ELSE 0 END + CASE WHEN hist > 0 THEN 3 ELSE 0 END + CASE WHEN c > y20 AND c > y50 THEN 1 ELSE 0 END + CASE WHEN c <= bb_lower THEN 1 ELSE 0 END + CASE WHEN stoch < 20 THEN 1 ELSE 0 END + CASE WHEN ret_5 >= 0.5 THEN 1 ELSE 0 END AS buy_points,
 CASE WHEN rsi > 70 THEN 4 WHEN rsi > 60 THEN 1 ELSE 0 END + CASE WHEN hist > 0 THEN 0 ELSE 3 END + CASE WHEN c < y20 AND c < y50 THEN 1 ELSE 0 END + CASE WHEN c > bb_lower AND c >= bb_upper THEN 1 ELSE 0 END + CASE WHEN stoch > 80 THEN 1 ELSE 0 END + CASE WHEN ret_5 <= -0.5 THEN 1 ELSE 0 END AS sell_points FROM x)
SELECT symbol, ts_ms, CAST(buy_points AS INT) AS buy_points, CAST(sell_points AS INT) AS sell_points, CASE WHEN buy_points > sell_points + 1 THEN 'BUY' WHEN sell_points > buy_points + 1 THEN 'SELL' ELSE 'HOLD' END AS action,
 CAST(CASE WHEN abs(buy_points - sell_points) > 1 THEN least(85, 50 + abs(buy_points - sell_points) * 8) ELSE greatest(40, least(85, 50 + abs(buy_points - sell_points) * 8) - 15) END AS INT) AS confidence FROM p""")
def b13_overall_calls(spark, d):
    """The overall technical call of bars with 50 or more before, the five-bar return standing for the day's change."""
    b = indicators.with_indicators(bars(spark, d))
    for k in (12, 20, 26, 50):
        b = ema(b, "c", k, f"ema_{k}")
    b = ema(b.withColumn("line", F.col("ema_12") - F.col("ema_26")), "line", 9, "signal").where("n >= 50")
    b = b.withColumns({"hist": F.col("line") - F.col("signal"), "change_pct": F.col("ret_5")})
    return holdings.overall_call(b).select("symbol", "ts_ms", "buy_points", "sell_points", "action", "confidence")


@query(f"""WITH {DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM daily WHERE c > 0)
SELECT symbol, max(c) FILTER (k <= 252) AS year_high, min(c) FILTER (k <= 252) AS year_low, round(CASE WHEN count(*) >= 50 THEN avg(c) FILTER (k <= 50) END, 4) AS mean_50, round(CASE WHEN count(*) >= 200 THEN avg(c) FILTER (k <= 200) END, 4) AS mean_200 FROM k GROUP BY symbol""")
def b17_key_stats(spark, d):
    """Extremes of a year of closes and the means of the last 50 and 200, null when there are fewer."""
    p = archive.latest(daily(spark, d).where("c > 0").withColumnRenamed("day", "ts_ms"), 252)
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts_ms"))))
    mean = lambda n: F.round(F.when(F.count("*") >= n, F.avg(F.when(F.col("k") <= n, F.col("c")))), 4)
    return p.groupBy("symbol").agg(F.max("c").alias("year_high"), F.min("c").alias("year_low"), mean(50).alias("mean_50"), mean(200).alias("mean_200"))


@query("""WITH q AS (SELECT event_type AS symbol, event_id % 3 AS provider, last(value ORDER BY ts, event_id NULLS FIRST, value) AS price FROM events WHERE event_id % 3 <> 0 AND value > 0 GROUP BY 1, 2), f AS (SELECT symbol, first(price ORDER BY provider) AS quoted FROM q GROUP BY symbol),
h AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' ELSE 'nothing' END AS symbol, CASE WHEN c_custkey % 5 = 0 THEN 'mf' ELSE 'stock' END AS type, c_acctbal AS stored FROM customer)
SELECT id, h.symbol, round(CASE WHEN type = 'mf' THEN stored ELSE coalesce(quoted, stored) END, 6) AS price FROM h LEFT JOIN f ON f.symbol = h.symbol""")
def d11_latest_prices(spark, d):
    """Holdings at the newest quote of the first provider that has one."""
    q = load(spark, d, "events").where("event_id % 3 <> 0").select(F.col("event_type").alias("symbol"), (F.col("event_id") % 3).alias("provider"), F.struct("ts", "event_id", "value").alias("ts"), F.col("value").alias("price"))
    h = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' ELSE 'nothing' END").alias("symbol"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'mf' ELSE 'stock' END").alias("type"), F.col("c_acctbal").alias("stored"))
    return rounded(holdings.latest_prices(h, q).select("id", "symbol", "price"))


@query("WITH u AS (SELECT upper(p_name) AS name FROM part UNION SELECT upper(p_brand) FROM part) SELECT name FROM u WHERE contains(name, 'WI') AND name NOT IN (SELECT upper(p_name) FROM part WHERE p_size = 10) ORDER BY CASE WHEN name LIKE 'WI%' THEN 0 ELSE 1 END, name LIMIT 8")
def h3_universe_search(spark, d):
    """Names of parts and brands that hold WI, without those held in size 10."""
    p = load(spark, d, "part")
    names = p.select(F.col("p_name").alias("name")).union(p.select("p_brand"))
    return holdings.search(names, p.where("p_size = 10").select(F.col("p_name").alias("name")), "wi")


# headlines

NEWS = f"""news AS (SELECT doc_id AS ts, {HEAD} AS headline, upper(lang) AS tag, CASE WHEN regexp_matches(lower({HEAD}), '{trend.BAD}') THEN 'negative' WHEN regexp_matches(lower({HEAD}), '{trend.GOOD}') THEN 'positive' ELSE 'neutral' END AS mood FROM documents WHERE {HEAD} <> ''),
assets AS (SELECT DISTINCT upper(lang) AS asset, '(^|[ .,])' || lang || '([ .,]|$)' AS pattern FROM documents WHERE lang IS NOT NULL), rel AS (SELECT asset, ts, headline, mood FROM news JOIN assets ON tag = asset OR regexp_matches(lower(headline), pattern))"""


def _relevant(spark, d):
    """Headlines with the language as tag, and languages as assets whose code is also looked for as a word."""
    docs, head = load(spark, d, "documents"), F.substring_index("text", "\n", 1)
    news = docs.select(F.col("doc_id").alias("ts"), head.alias("headline"), F.array(F.upper("lang")).alias("tags"), trend.mood(head).alias("mood")).where("headline <> ''")
    assets = docs.where("lang is not null").select(F.upper("lang").alias("asset"), F.concat(F.lit("(^|[ .,])"), "lang", F.lit("([ .,]|$)")).alias("pattern")).distinct()
    return holdings.relevant(news, assets)


@query(f"WITH {NEWS} SELECT asset, count(*) AS headlines, max(ts) AS ts, last(headline ORDER BY ts) AS latest FROM rel GROUP BY asset")
def d10_relevant_headlines(spark, d):
    return _relevant(spark, d).groupBy("asset").agg(F.count("*").alias("headlines"), F.max("ts").alias("ts"), F.max_by("headline", "ts").alias("latest"))


@query(f"""WITH {NEWS}, pr AS (SELECT upper(lang) AS asset, sum(n_chars) FILTER (doc_id % 2 = 1) AS cur, sum(n_chars) FILTER (doc_id % 2 = 0) AS prev FROM documents WHERE lang IS NOT NULL GROUP BY 1),
p AS (SELECT asset, CASE WHEN prev <> 0 THEN (cur - prev) / prev * 100 ELSE 0 END AS pct FROM pr), q AS (SELECT *, CASE WHEN pct > 0.15 THEN 'up' WHEN pct < -0.15 THEN 'down' ELSE 'flat' END AS direction FROM p),
n AS (SELECT *, CASE mood WHEN 'positive' THEN 'up' ELSE 'down' END AS direction, row_number() OVER (PARTITION BY asset, mood ORDER BY ts DESC) AS k FROM rel WHERE mood <> 'neutral')
SELECT q.asset, round(any_value(pct), 6) AS pct, q.direction, coalesce(string_agg(headline, ' | ' ORDER BY k), '') AS reasons FROM q LEFT JOIN n ON n.asset = q.asset AND n.direction = q.direction AND k <= 2 GROUP BY q.asset, q.direction""")
def h4_move_reasons(spark, d):
    """Each asset's move and the newest two headlines of the mood that fits it."""
    n = F.col("n_chars")
    p = load(spark, d, "documents").where("lang is not null").groupBy(F.upper("lang").alias("asset")).agg(F.sum(F.when(F.col("doc_id") % 2 == 1, n)).alias("cur"), F.sum(F.when(F.col("doc_id") % 2 == 0, n)).alias("prev"))
    return rounded(holdings.explain_moves(p, _relevant(spark, d)))


@query(f"""WITH h AS (SELECT doc_id, trim(regexp_replace({HEAD}, '\\s+', ' ', 'g')) AS t, source FROM documents) SELECT CASE WHEN doc_id % 2 = 0 THEN 'doc-' || doc_id ELSE t END AS id, t AS headline,
 CASE WHEN doc_id % 5 = 0 THEN 0 ELSE epoch_ms(TIMESTAMP '2024-01-01 10:30:00') + (doc_id % 300) * 86400000 END AS ts_ms, source FROM h WHERE t <> '' AND source <> ''""")
def b14_rss_headlines(spark, d):
    """Headlines of feeds built from documents: escaped, with the publisher behind, dates and keys at times missing."""
    head = F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), r"\s+", " "))
    esc = head
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;"), ("'", "&#39;")):
        esc = F.replace(esc, F.lit(char), F.lit(name))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "dd MMM yyyy")
    pub = F.when(F.col("doc_id") % 5 == 0, "soon").otherwise(F.concat(F.lit("Mon, "), day, F.lit(" 10:30:00 GMT")))
    guid = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<guid isPermaLink='false'>doc-"), "doc_id", F.lit("</guid>"))).otherwise("")
    body = F.concat(F.lit("<rss><item><title><![CDATA["), esc, F.lit(" - "), "source", F.lit("]]></title>"), guid, F.lit("<pubDate>"), pub, F.lit("</pubDate><source url='x'>"), "source", F.lit("</source></item></rss>"))
    docs = load(spark, d, "documents").where((head != "") & (F.col("source") != ""))
    return holdings.rss_items(docs.select(body.alias("body")))


# books


@query(f"""WITH {TRADES}, t AS (SELECT CASE pool WHEN 'O' THEN 'live' ELSE 'shadow' END AS kind, CASE WHEN line < 7 THEN pts - 0.5::DOUBLE END AS net FROM trades),
g AS (SELECT kind, count(net) AS trades, count(*) - count(net) AS open, count(*) FILTER (net > 0) AS wins, sum(net) AS net, avg(net) AS average, max(net) AS best, min(net) AS worst FROM t GROUP BY kind)
SELECT kind, trades, open, wins, round(net, 4) AS net, round(average, 6) AS average, round(best, 6) AS best, round(worst, 6) AS worst, round(wins / trades * 100, 6) AS win_pct, round((SELECT average FROM g WHERE kind = 'live') - (SELECT average FROM g WHERE kind = 'shadow'), 6) AS took_over_declined FROM g""")
def e28_book_summary(spark, d):
    """The live and the shadow book, and what the trades taken made over those declined."""
    t = _trades(spark, d).select(F.when(F.col("pool") == "O", "live").otherwise("shadow").alias("kind"), F.when(F.col("line") < 7, F.col("pts") - 0.5).alias("net"))
    g = holdings.book_summary(t)
    over = g.agg((F.max(F.when(F.col("kind") == "live", F.col("average"))) - F.max(F.when(F.col("kind") == "shadow", F.col("average")))).alias("took_over_declined"))
    return rounded(g.withColumn("net", F.round("net", 4)).crossJoin(over))


@query(COST + """, c AS (SELECT id, line, (40 + s * 75 * 0.001 + (b + s) * 75 * 0.0003503 + (b + s) * 75 * 0.000001 + b * 75 * 0.00003 + (40 + (b + s) * 75 * 0.0003503 + (b + s) * 75 * 0.000001) * 0.18 + 0.05 * 75 * 2) / 75 AS charges, 0.35::DOUBLE + line * 0.05::DOUBLE AS delta FROM t)
SELECT id % 100 AS chain, count(*) AS strikes, round(median(charges / delta), 6) AS index_cost, round(min(charges / delta), 6) AS best, round(max(charges / delta), 6) AS worst, round(median(charges), 6) AS charges, round(median(delta), 6) AS delta FROM c GROUP BY 1""")
def e29_chain_costs(spark, d):
    """Costs of an option round trip in index points, over the strikes of a chain."""
    t = load(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("chain"), (F.col("l_extendedprice") / 100).alias("b"), (F.col("l_extendedprice") * (1 + F.col("l_tax") - F.col("l_discount")) / 100).alias("s"), (F.col("l_linenumber") * 0.05 + 0.35).alias("delta"))
    t = t.select("chain", "delta", (m.option_buy_cost(F.col("b"), F.col("s")) / 75).alias("charges")).withColumn("cost", F.col("charges") / F.col("delta"))
    return rounded(t.groupBy("chain").agg(F.count("*").alias("strikes"), F.median("cost").alias("index_cost"), F.min("cost").alias("best"), F.max("cost").alias("worst"), F.median("charges").alias("charges"), F.median("delta").alias("delta")))


COPIES = """SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS pos, CASE l_suppkey % 4 WHEN 0 THEN 'target' WHEN 1 THEN 'expired' WHEN 2 THEN 'pending' END AS status, CAST(l_quantity AS INT) % 3 AS updates, l_tax AS peak, l_partkey % 5 AS ts_ms, l_linestatus AS place FROM lineitem"""


@query(f"""WITH c AS ({COPIES}), r AS (SELECT *, CASE status WHEN 'target' THEN 3 WHEN 'expired' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END AS rank, CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END AS log FROM c),
e AS (SELECT id, list_reduce(list({{'log': log, 'pos': pos, 'rank': rank, 'status': status, 'updates': updates, 'peak': peak, 'ts_ms': ts_ms}} ORDER BY log, pos), lambda a, b: CASE WHEN b.rank > a.rank OR (b.rank = a.rank AND (b.updates > a.updates OR b.peak > a.peak OR b.ts_ms > a.ts_ms)) THEN b ELSE a END) AS e FROM r GROUP BY id)
SELECT id, e.log, e.pos, e.status, e.updates, e.peak, e.ts_ms FROM e""")
def g14_merged_logs(spark, d):
    """Two logs of the same signals merged by id, each order's lines standing for the copies of one signal."""
    load(spark, d, "lineitem").createOrReplaceTempView("__copies")
    c = spark.sql(COPIES.replace("FROM lineitem", "FROM __copies")).drop("place")
    return holdings.merge_logs(c.where("pos % 2 = 1"), c.where("pos % 2 = 0"))


DBARS = f"{DAILY}, bars AS (SELECT symbol, epoch_ms(CAST(day AS TIMESTAMP)) AS ts_ms, o, h, l, c, v FROM daily)"
SIXTY = 60 * 86_400_000


@query(f"WITH RECURSIVE {MERGED.replace(BARS, DBARS).replace('WHERE action IS NOT NULL', 'WHERE action IS NOT NULL AND abs(rsi - 50) >= 8')}, {graded_sql(SIXTY).replace('+ 0.5', '').replace('- 0.5', '')} SELECT symbol, first_ms, action, status, round(resolved_price, 6) AS resolved_price FROM graded")
def g13_holding_log(spark, d):
    """Sure readings of each symbol's daily bars, merged against its own latest and graded over 60 days without a least distance."""
    b = daily(spark, d).withColumn("ts_ms", F.unix_date("day").cast("long") * 86_400_000).drop("day")
    s = signals.merge_signals(signals.band_signals(indicators.with_indicators(b)).where("confidence >= 8"))
    s = s.withColumn("sid", F.concat(F.col("first_ms").cast("string"), "symbol")).withColumn("ts_ms", F.col("first_ms"))
    return rounded(grading.grade(s, b, SIXTY).select("symbol", "first_ms", "action", "status", "resolved_price"))
