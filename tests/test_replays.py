import pytest
from pyspark.sql import functions as F

from candlemill.operators import grading, holdings, learn, replay, structure
from candlemill.streaming.grading import FEED, feed, grade_stream

BAR = "symbol string, ts_ms long, o double, h double, l double, c double, v double"
DAY = 19_700 * 86_400_000 - 19_800_000 + 600 * 60_000  # 10:00 at +05:30


def _bars(spark, closes, symbol="A", wide=1.0, v=1.0):
    rows = [(symbol, DAY + k * 300_000, float(c), c + wide, c - wide, float(c), v) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def _slow_band(rows, period, width):
    """Supertrend read off its definition, in lists."""
    true = [None] + [max(b[0] - b[1], abs(b[0] - a[2]), abs(b[1] - a[2])) for a, b in zip(rows, rows[1:])]
    out, atr, up, upper, lower = {}, sum(true[1 : period + 1]) / period, None, None, None
    for k in range(period, len(rows)):
        h, low, c = rows[k]
        if k > period:
            atr = (atr * (period - 1) + true[k]) / period
        mid = (h + low) / 2
        if up is None:
            upper, lower, up = mid + width * atr, mid - width * atr, c >= mid
        else:
            was = rows[k - 1][2]
            upper = mid + width * atr if was > upper or mid + width * atr < upper else upper
            lower = mid - width * atr if was < lower or mid - width * atr > lower else lower
            up = c >= lower if up else c > upper
        out[k] = (round(lower if up else upper, 9), up)
    return out


def test_supertrend_over_symbols(spark):
    walk = [100 + (k * 37 % 23) - (k // 9) * (-1) ** (k // 20) * 3 for k in range(80)]
    b = _bars(spark, walk).union(_bars(spark, walk[::-1], "B")).union(_bars(spark, [1, 2], "C"))
    got = {}
    for r in replay.supertrend(b, 5, 1.5).collect():
        got.setdefault(r.symbol, {})[(r.ts_ms - DAY) // 300_000] = (round(r.value, 9), r.rising)
    of = lambda closes: _slow_band([(c + 1, c - 1, c) for c in closes], 5, 1.5)
    assert got == {"A": of(walk), "B": of(walk[::-1])}


def test_cross_trades_hold_one_slot(spark):
    dip = [110, 108, 104, 100, 97, 96, 99, 104, 109, 112, 108, 102, 97, 99, 106, 111]
    variants = spark.createDataFrame([("v", "both", 3.0, 0.0), ("longs", "LONG", 3.0, 0.0), ("none", "both", 3.0, 99.0)], "variant string, sides string, stop_pts double, min_rr double")
    rows = replay.cross_trades(_bars(spark, dip), variants, period=3, warmup=2, least_bars=5).collect()
    crosses = {r.ts_ms for r in rows if r.variant == "v"}
    assert crosses and all({r.ts_ms for r in rows if r.variant == v} == crosses for v in ("longs", "none"))  # every cross accounted for
    taken = sorted((r for r in rows if r.verdict == "taken" and r.variant == "v"), key=lambda r: r.ts_ms)
    assert taken and all(r.entry_ms == r.ts_ms + 300_000 and r.exit_ms >= r.entry_ms for r in taken)
    assert all(b.ts_ms > a.exit_ms for a, b in zip(taken, taken[1:]))
    assert not [r for r in rows if r.variant == "none" and r.verdict == "taken"]
    assert {r.direction for r in rows if r.variant == "longs" and r.verdict == "taken"} <= {"LONG"}
    assert replay.cross_trades(_bars(spark, dip, v=0.0), variants, least_bars=5).count() == 0


def test_breaks_look_back_only(spark):
    walk = [100, 104, 102, 99, 101, 106, 103, 98, 95, 99, 107, 104, 101, 97, 93, 96]
    whole = {tuple(r) for r in structure.breaks(_bars(spark, walk)).collect()}
    short = {tuple(r) for r in structure.breaks(_bars(spark, walk[:11])).collect()}
    until = DAY + 10 * 300_000
    # the last bar's own imbalance needs the bar after it, which no break at or before it reads
    assert short == {r for r in whole if r[1] <= until} and short


def test_entities_and_titles(spark):
    body = "<item><title>A &amp;lt; B&#233;&#x; &#8364; &quot;x&quot; - Pub</title><source>Pub</source><link>u</link><pubDate>Tue, 02 Jan 2024 00:00:01 GMT</pubDate></item><item><title></title></item><item><title>plain</title></item>"
    got = [tuple(r) for r in holdings.rss_items(spark.createDataFrame([(body,), (None,), ("",)], "body string")).collect()]
    assert got == [("u", 'A &lt; Bé&#x; € "x"', 1704153601000, "Pub"), ("plain", "plain", 0, "News")]


def test_merged_logs_follow_order(spark):
    log = "id int, pos int, status string, updates int, peak double, ts_ms long"
    server = spark.createDataFrame([(1, 0, "pending", 1, 80.0, 5), (2, 0, "stop", 1, 80.0, 5), (3, 0, None, 1, None, 5)], log)
    local = spark.createDataFrame([(1, 0, "pending", 2, 70.0, 1), (2, 0, "pending", 9, 99.0, 9), (1, 1, "pending", 1, 75.0, 1)], log)
    got = {r.id: (r.log, r.pos) for r in holdings.merge_logs(server, local).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (0, 0)}
    assert [r.id for r in holdings.merge_logs(server, local, 1).collect()] == [2]


def test_dataset_keeps_its_cost(spark, tmp_path):
    learn.save_dataset(spark.range(3), f"file://{tmp_path}/d", 6.0)
    rows, cost = learn.load_dataset(spark, f"file://{tmp_path}/d")
    assert (rows.count(), cost) == (3, 6.0)
    for bad in (-1.0, 200.0, float("nan")):
        with pytest.raises(ValueError):
            learn.save_dataset(spark.range(1), f"file://{tmp_path}/e", bad)


def test_folds_see_only_the_past(spark):
    s = spark.range(900).select(F.col("id").alias("at"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 7 > 3, 1).otherwise(0).alias("label"))
    scored = learn.walk_forward(s, ["x"], ["at"], blocks=2)
    assert {r[0] for r in scored.select("at").collect()} == set(range(400, 900))
    assert scored.where("(score > 0.5) <> (label = 1)").count() == 0
    assert learn.walk_forward(s.where("at < 300"), ["x"], ["at"]).count() == 0
    assert learn.gated(s.withColumn("vix", F.lit(1.0)), 2.0, 901).count() == 0


def test_stream_grades_like_the_batch(spark, tmp_path):
    prices = [100, 101, 99, 103, 107, 98, 94, 100, 100, 100, 100, 100]
    bars = _bars(spark, prices, wide=0.5)
    rows = [(f"s{k}", "A", DAY + k * 300_000, way, float(prices[k]), prices[k] + s * t, prices[k] - s * 3.0) for k, (way, s, t) in enumerate([("BUY", 1, 5.0), ("SELL", -1, 4.0), ("BUY", 1, 50.0), ("SELL", -1, 2.0), ("BUY", 1, 30.0), ("BUY", 1, 3.0)])]
    sig = spark.createDataFrame(rows, "sid string, symbol string, ts_ms long, action string, entry double, target double, stop double")
    window = 5 * 300_000
    both = feed(sig, bars)
    for n, (a, z) in enumerate(((0, 3), (3, 5), (5, 12))):
        both.where(F.col("ts_ms").between(DAY + a * 300_000, DAY + z * 300_000 - 1)).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    q = grade_stream(stream, window).writeStream.format("memory").queryName("graded").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.sid, r.status, r.resolved_price, r.resolved_ms, r.mfe, r.mae) for r in spark.table("graded").collect())
    want = sorted((r.sid, r.status, r.resolved_price, r.resolved_ms, r.mfe, r.mae) for r in grading.grade(sig, bars, window).collect())
    assert got == want


def test_features_do_not_look_ahead(spark):
    from candlemill.operators.decisions import FEATURES
    from candlemill.plans.features import feature_rows

    walk = [100 + (k * 37 % 23) / 2 + (k % 11) * (-1) ** (k // 13) for k in range(120)]
    vix = spark.createDataFrame([("2023-12-07", 14.0), ("2023-12-09", 15.0)], "day string, close double").withColumn("day", F.to_date("day"))
    whole, part = (feature_rows(_bars(spark, walk[:n]), vix).orderBy("ts_ms").collect() for n in (120, 70))
    assert whole[0].__fields__ == ["symbol", "ts_ms", *FEATURES] and len(FEATURES) == 40
    near = lambda a, b: all(x == y or abs(x - y) < 1e-9 for x, y in zip(a, b))
    assert len(part) == 70 and all(near(a, b) for a, b in zip(part, whole))
