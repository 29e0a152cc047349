"""Holdings, watch lists, quotes, paper books, and the headlines that concern an asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Index names at the chart provider and at the exchange.
CHART_INDEX = {"NIFTY": "^NSEI", "NIFTY 50": "^NSEI", "NIFTY50": "^NSEI", "BANKNIFTY": "^NSEBANK", "NIFTY BANK": "^NSEBANK", "SENSEX": "^BSESN", "INDIAVIX": "^INDIAVIX"}
EXCHANGE_INDEX = {
    "NIFTY": "NSE:NIFTY50-INDEX", "NIFTY 50": "NSE:NIFTY50-INDEX", "NIFTY50": "NSE:NIFTY50-INDEX", "BANKNIFTY": "NSE:NIFTYBANK-INDEX", "NIFTY BANK": "NSE:NIFTYBANK-INDEX", "FINNIFTY": "NSE:FINNIFTY-INDEX",
    "MIDCPNIFTY": "NSE:MIDCPNIFTY-INDEX", "SENSEX": "BSE:SENSEX-INDEX", "INDIAVIX": "NSE:INDIAVIX-INDEX", "INDIA VIX": "NSE:INDIAVIX-INDEX", "VIX": "NSE:INDIAVIX-INDEX",
}
# Sector entries that say nothing, and the name of the bucket for those.
NO_SECTOR, UNSECTORED = ("", "other", "stock", "na", "n/a", "none", "unknown", "-", "—"), "Unsectored"


def _named(names: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def chart_symbol(symbol: Column, segment: Column) -> Column:
    """The chart provider's ticker; an index without an alias keeps its name."""
    s = F.upper(F.trim(symbol))
    share = F.when(s.startswith("^") | s.contains("."), s).when(segment == "EQUITY", F.concat(s, F.lit(".NS"))).otherwise(s)
    return F.when(segment == "INDEX", F.coalesce(_named(CHART_INDEX, s), symbol)).otherwise(share)


def exchange_symbol(symbol: Column, segment: Column) -> Column:
    """The exchange's ticker; null for an index that has none."""
    s = F.upper(F.trim(symbol))
    share = F.when(segment == "EQUITY", F.concat(F.lit("NSE:"), s, F.lit("-EQ"))).otherwise(F.concat(F.lit("NSE:"), s))
    return F.when(s.contains(":"), s).when(segment == "INDEX", _named(EXCHANGE_INDEX, s)).otherwise(share)


def sector_name(value: Column) -> Column:
    """A sector, null where the entry is a placeholder."""
    v = F.trim(value)
    return F.when(~F.lower(v).isin(*NO_SECTOR), v)


def with_sector(holdings: DataFrame, table: DataFrame) -> DataFrame:
    """holdings(symbol, live_sector, stored_sector) with sector: live, stored, then table(symbol, table_sector), else UNSECTORED; unknown says to sort last."""
    out = holdings.join(table, "symbol", "left")
    sector = F.coalesce(sector_name(F.col("live_sector")), sector_name(F.col("stored_sector")), F.col("table_sector"), F.lit(UNSECTORED))
    return out.withColumn("sector", sector).withColumn("unknown", F.col("sector") == UNSECTORED).drop("table_sector")


def _call(action: str, confidence: int) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(confidence).alias("confidence"))


def watch_call(change: Column, price: Column) -> Column:
    """A watched symbol's call by its day: extended moves are not chased, dips are watched."""
    return (
        F.when(price.isNull() | (price == 0), _call("WAIT", 0)).when(change >= 2, _call("SELL", 58)).when(change <= -2, _call("BUY", 58))
        .when(change >= 0.8, _call("HOLD", 45)).when(change <= -0.8, _call("BUY", 50)).otherwise(_call("HOLD", 40))
    )


def holding_call(gain: Column, change: Column, profit: float = 1.5, loss: float = 0.8) -> Column:
    """A holding's call by its gain on cost, then by its day; null gain waits."""
    return (
        F.when(gain.isNull(), _call("WAIT", 0)).when(gain <= -5, _call("BUY", 65)).when(gain >= profit, _call("SELL", 70)).when(gain <= -loss, _call("SELL", 72))
        .when(change >= 1.5, _call("SELL", 55)).when(change <= -1.5, _call("BUY", 55)).otherwise(_call("HOLD", 45))
    )


def overall_call(df: DataFrame) -> DataFrame:
    """Adds buy_points, sell_points, action and confidence to bars with rsi, hist, c, ema_20, ema_50, bands, stoch and change_pct.

    The indicator rows count one each; RSI and MACD count again by their own weight.
    """
    c = F.col
    above, below = (c("c") > c("ema_20")) & (c("c") > c("ema_50")), (c("c") < c("ema_20")) & (c("c") < c("ema_50"))
    buy = [(c("rsi") < 30, 4), ((c("rsi") >= 30) & (c("rsi") < 40), 1), (c("hist") > 0, 3), (above, 1), (c("c") <= c("bb_lower"), 1), (c("stoch") < 20, 1), (c("change_pct") >= 0.5, 1)]
    sell = [(c("rsi") > 70, 4), ((c("rsi") <= 70) & (c("rsi") > 60), 1), (~(c("hist") > 0), 3), (below, 1), ((c("c") > c("bb_lower")) & (c("c") >= c("bb_upper")), 1), (c("stoch") > 80, 1), (c("change_pct") <= -0.5, 1)]
    points = lambda rules: sum((F.when(r, n).otherwise(0) for r, n in rules), F.lit(0))
    d = df.withColumns({"buy_points": points(buy), "sell_points": points(sell)})
    gap = c("buy_points") - c("sell_points")
    sure = F.least(F.lit(85), 50 + F.abs(gap) * 8)
    d = d.withColumn("action", F.when(gap > 1, "BUY").when(gap < -1, "SELL").otherwise("HOLD"))
    return d.withColumn("confidence", F.when(F.abs(gap) > 1, sure).otherwise(F.greatest(F.lit(40), sure - 15)))


def latest_prices(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """holdings(id, symbol, type, stored) with price: the newest quote(symbol, provider, ts, price) of the first provider that has one; funds and the unquoted keep what is stored.

    Quotes shrink to one a (symbol, provider) before anything is joined.
    """
    newest = quotes.where("price > 0").groupBy("symbol", "provider").agg(F.max_by("price", "ts").alias("price"))
    first = newest.groupBy("symbol").agg(F.min_by("price", "provider").alias("quoted"))
    return holdings.join(first, "symbol", "left").withColumn("price", F.when(F.col("type") == "mf", F.col("stored")).otherwise(F.coalesce("quoted", "stored"))).drop("quoted")


def ranked(calls: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Adds place: BUY, SELL, then the rest, surest first."""
    group = F.when(F.col("action") == "BUY", 0).when(F.col("action") == "SELL", 1).otherwise(2)
    return calls.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(group, F.desc(F.coalesce("confidence", F.lit(0))), tie)))


def search(names: DataFrame, held: DataFrame, query: str, top: int = 8) -> DataFrame:
    """The few names(name) that contain query and are not held(name), those that begin with it first; a report with a limit by design."""
    q = query.strip().upper()
    found = names.select(F.upper("name").alias("name")).distinct().where(F.col("name").contains(q))
    free = found.join(held.select(F.upper("name").alias("name")).distinct(), "name", "left_anti")
    return free.orderBy(F.when(F.col("name").startswith(q), 0).otherwise(1), "name").limit(top)


#: Most assets whose patterns become literals of one scan; more are joined by the pattern.
LITERAL_ASSETS = 200


def relevant(news: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset, ts, headline, mood) of news(ts, headline, tags, mood) that an asset(asset, pattern) is tagged in or that fits its pattern.

    Up to LITERAL_ASSETS names are tested as literals in one scan of the news, without a join; a
    larger table of names is joined by the same rule.
    """
    known = assets.limit(LITERAL_ASSETS + 1).collect()
    if len(known) > LITERAL_ASSETS:
        fits = F.array_contains("tags", F.col("asset")) | F.regexp_like(F.lower("headline"), F.col("pattern"))
        return news.join(assets, fits).select("asset", "ts", "headline", "mood")
    low = F.lower("headline")
    tests = [F.when(F.array_contains("tags", a.asset) | low.rlike(a.pattern), a.asset) for a in known if a.asset is not None and a.pattern is not None]
    met = F.filter(F.array(*tests).cast("array<string>"), lambda a: a.isNotNull())
    return news.select(F.explode(met).alias("asset"), "ts", "headline", "mood")


def dedupe(holdings: DataFrame, owner: str, position: list[str]) -> DataFrame:
    """One row of holdings(owner, id, type, name, sector, buy) an owner, type and name in any case: the first with a cost, else the first.

    A type that is not mf is stock, a placeholder for a sector is null, rows without a name go. An id
    that is null or that an earlier row of the owner has is replaced by one above all the owner's.
    """
    h = holdings.where("name <> ''").withColumns({"type": F.when(F.lower("type") == "mf", "mf").otherwise("stock"), "sector": sector_name(F.col("sector")), "__name": F.upper("name")})
    key = Window.partitionBy(owner, "type", "__name")
    best = F.row_number().over(key.orderBy((F.coalesce("buy", F.lit(0)) > 0).desc(), *position))
    h = h.withColumns({"__k": best, "__first": F.min(F.struct(*position)).over(key), "__most": F.coalesce(F.max("id").over(Window.partitionBy(owner)), F.lit(0))}).where("__k = 1")
    taken = F.col("id").isNull() | (F.row_number().over(Window.partitionBy(owner, "id").orderBy("__first")) > 1)
    h = h.withColumn("__new", taken)
    fresh = F.col("__most") + F.sum(F.col("__new").cast("long")).over(Window.partitionBy(owner).orderBy("__first"))
    return h.withColumn("id", F.when(F.col("__new"), fresh).otherwise(F.col("id"))).drop("__name", "__k", "__first", "__most", "__new")


def explain_moves(prices: DataFrame, matched: DataFrame, top: int = 2) -> DataFrame:
    """(asset, pct, direction, reasons) of prices(asset, cur, prev) and what relevant() matched: the newest few headlines of the mood that fits the move."""
    pct = F.when(F.col("prev") != 0, (F.col("cur") - F.col("prev")) / F.col("prev") * 100).otherwise(0.0)
    p = prices.withColumn("pct", pct).withColumn("direction", F.when(F.col("pct") > 0.15, "up").when(F.col("pct") < -0.15, "down").otherwise("flat"))
    k = F.row_number().over(Window.partitionBy("asset", "mood").orderBy(F.desc("ts")))
    newest = matched.where("mood <> 'neutral'").withColumn("k", k).where(F.col("k") <= top)
    said = newest.groupBy("asset", F.when(F.col("mood") == "positive", "up").otherwise("down").alias("direction")).agg(F.array_sort(F.collect_list(F.struct("k", "headline"))).alias("r"))
    return p.join(said, ["asset", "direction"], "left").select("asset", "pct", "direction", F.coalesce(F.array_join(F.transform("r", lambda x: x["headline"]), " | "), F.lit("")).alias("reasons"))


def rss_items(feeds: DataFrame) -> DataFrame:
    """(id, headline, ts_ms, source) of each titled <item> in feeds(body).

    Entities are decoded, a publisher at the end of the title is cut, a date that is none gives 0.
    """
    item = feeds.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<item[^>]*>(.*?)</item>"), F.lit(1))).alias("item"))

    def tag(name: str) -> Column:
        raw = F.nullif(F.regexp_extract("item", rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), F.lit(""))
        return decode_entities(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))

    d = item.select(tag("title").alias("title"), tag("source").alias("source"), tag("guid").alias("guid"), tag("link").alias("link"), tag("pubDate").alias("pub")).where("title <> ''")
    tail = F.concat(F.lit(" - "), F.col("source"))
    headline = F.when(F.col("title").endswith(tail), F.trim(F.left("title", F.char_length("title") - F.char_length(tail)))).otherwise(F.col("title"))
    date = F.regexp_extract("pub", r"(\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) (?:GMT|UTC|\+0000)$", 1)
    ms = F.when(date != "", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', to_timestamp_ntz(date, 'dd MMM yyyy HH:mm:ss'))")).otherwise(0)
    d = d.withColumn("headline", headline).withColumn("date", date)
    key = F.coalesce(F.nullif("guid", F.lit("")), F.nullif("link", F.lit("")), F.col("headline"))
    return d.select(key.alias("id"), "headline", F.coalesce(ms, F.lit(0)).cast("long").alias("ts_ms"), F.coalesce(F.nullif("source", F.lit("")), F.lit("News")).alias("source"))


def decode_entities(text: Column) -> Column:
    """Numeric references, then the named ones that feeds use, once; trimmed."""
    parts = F.split(text, r"&#(?=\d{1,6};)", -1)
    code = lambda p: F.decode(F.unhex(F.lpad(F.hex(F.regexp_extract(p, r"^\d+", 0).cast("long")), 8, "0")), "UTF-32")
    out = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(code(p), F.regexp_replace(p, r"^\d+;", "")))), "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.regexp_replace(out, f"(?i)&{name};", char)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def book_summary(trades: DataFrame, kind: str = "kind") -> DataFrame:
    """Per kind of book: closed and open trades, wins, and net, mean, best and worst of the closed ones; trades(net null while open)."""
    closed = F.col("net").isNotNull()
    g = trades.groupBy(kind).agg(
        F.count("net").alias("trades"), F.count(F.when(~closed, 1)).alias("open"), F.count(F.when(F.col("net") > 0, 1)).alias("wins"),
        F.sum("net").alias("net"), F.avg("net").alias("average"), F.max("net").alias("best"), F.min("net").alias("worst"),
    )
    return g.withColumn("win_pct", F.when(F.col("trades") > 0, F.col("wins") / F.col("trades") * 100))


def merge_logs(server: DataFrame, local: DataFrame, newest: int | None = None) -> DataFrame:
    """One entry an id of two logs(id, pos, status, updates, peak, ts_ms): a better outcome wins, and of equal ones a later copy that exceeds in updates, peak or time.

    Which copy stays can depend on their order, so it is fixed: server before local, then pos. An
    id's copies, a few by nature, are folded by themselves.
    """
    rank = F.when(F.col("status").isin("target", "stop"), 3).when(F.col("status") == "expired", 2).when(F.col("status") == "pending", 1).otherwise(0)
    both = server.withColumn("log", F.lit(0)).unionByName(local.withColumn("log", F.lit(1))).withColumn("rank", rank)
    copies = both.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("log", "pos", "rank", "status", "updates", "peak", "ts_ms"))).alias("x"))

    def better(a: Column, b: Column) -> Column:
        more = (b["updates"] > a["updates"]) | (b["peak"] > a["peak"]) | (b["ts_ms"] > a["ts_ms"])
        return F.when((b["rank"] > a["rank"]) | ((b["rank"] == a["rank"]) & more), b).otherwise(a)

    kept = copies.select("id", F.aggregate("x", F.element_at("x", 1), better).alias("e")).select("id", "e.log", "e.pos", "e.status", "e.updates", "e.peak", "e.ts_ms")
    return kept if newest is None else kept.orderBy(F.desc("ts_ms"), "id").limit(newest)


#: What the balance of recent headlines and the fundamentals score do to a call; fixed values.
NEWS_ITEMS, NEWS_SURE, NEWS_MOST = 8, 2, 92
FUNDAMENTAL_WEIGHT = {"scalp": 3, "swing": 3, "longterm": 7}


def news_balance(news: DataFrame, key: str = "symbol", items: int = NEWS_ITEMS) -> DataFrame:
    """(key, n_news, news_score): positive less negative of each key's newest headlines of news(key, ts, mood)."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts")))
    recent = news.withColumn("__k", k).where(F.col("__k") <= items)
    score = F.sum(F.when(F.col("mood") == "positive", 1).when(F.col("mood") == "negative", -1).otherwise(0))
    return recent.groupBy(key).agg(F.count("*").alias("n_news"), score.cast("int").alias("news_score"))


def holding_view(calls: DataFrame, mode: str = "swing") -> DataFrame:
    """calls(action, confidence, n_news, news_score, fundamental_score) turned by headlines, then by fundamentals; nulls turn nothing.

    Two headlines or more against a call make it a HOLD, as many with it make it surer. A score of two
    or worse against a BUY makes it a HOLD; long-term holdings follow the score further.
    """
    score, conf, action = F.coalesce("news_score", F.lit(0)), F.col("confidence").cast("double"), F.col("action")
    against = ((score <= -NEWS_SURE) & (action == "BUY")) | ((score >= NEWS_SURE) & (action == "SELL"))
    along = ((score >= NEWS_SURE) & (action == "BUY")) | ((score <= -NEWS_SURE) & (action == "SELL"))
    less = F.greatest(F.lit(40.0), conf - F.when(action == "BUY", 15).otherwise(12))
    conf = F.when(against, less).when(along, F.least(F.lit(float(NEWS_MOST)), conf + 8)).otherwise(conf)
    d = calls.withColumns({"confidence": conf, "action": F.when(against, "HOLD").otherwise(action)})
    f, held = F.col("fundamental_score"), F.col("action")
    moved = F.col("confidence") + F.floor(F.least(F.greatest(f, F.lit(-3.0)), F.lit(3.0)) * FUNDAMENTAL_WEIGHT[mode] + 0.5)
    conf = F.when(f.isNotNull(), F.least(F.greatest(moved, F.lit(30.0)), F.lit(95.0))).otherwise(F.col("confidence"))
    if mode == "longterm":
        held = F.when((f >= 2) & (held == "HOLD"), "BUY").otherwise(held)
        held = F.when((f >= 1.5) & (held == "SELL"), "HOLD").otherwise(held)
        held = F.when((f <= -2) & (held == "BUY"), "HOLD").otherwise(held)
        held = F.when(f <= -3, "SELL").otherwise(held)
    else:
        held = F.when((f <= -2) & (held == "BUY"), "HOLD").otherwise(held)
    return d.withColumns({"confidence": F.floor(conf + 0.5).cast("int"), "action": held})


def gated_view(levelled: DataFrame) -> DataFrame:
    """Calls with their own levels: what is not viable becomes a HOLD at 12 points less, 30 at least."""
    lost = F.col("action").isin("BUY", "SELL") & ~F.col("viable")
    conf = F.when(lost, F.greatest(F.lit(30), F.least(F.lit(95), F.col("confidence") - 12))).otherwise(F.col("confidence"))
    return levelled.withColumns({"confidence": conf.cast("int"), "gated": lost, "action": F.when(lost, "HOLD").otherwise(F.col("action"))})
