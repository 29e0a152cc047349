from pyspark.sql import functions as F

from candlemill.operators import decisions, grading, trend

FACTOR = "array<struct<name:string,type:string,weight:double>>"


def _votes(spark, rows):
    df = spark.createDataFrame(rows, f"id int, factors {FACTOR}, change_pct double, thin boolean")
    return {r.id: (r.action, r.confidence) for r in decisions.vote(df).collect()}


def test_vote_handles_nulls_and_holds(spark):
    strong = [("RSI", "BUY", 3.0), ("VWAP", "BUY", None)]
    got = _votes(spark, [(1, strong, 0.6, False), (2, strong, 0.0, True), (3, None, None, None), (4, [("RSI", "SELL", 2.0)], -0.5, None), (5, [("RSI", "BUY", 2.0), ("VWAP", "SELL", 1.0)], 0.0, False)])
    # 42 + 35 + 4 * margin, at most 90; HOLD takes 12 and thin liquidity 5 more; 1/3 agreement gives 42 + 11.67 + 4 - 12
    assert got == {1: ("BUY", 90), 2: ("HOLD", 73), 3: ("HOLD", 38), 4: ("SELL", 89), 5: ("HOLD", 46)}


def test_levels_keep_reward_to_risk(spark):
    rows = [(1, 100.0, "BUY", 0.1, 99.0, 130.0), (2, 100.0, "BUY", 0.1, 99.0, 100.15), (3, 100.0, "SELL", None, None, None), (4, 100.0, "HOLD", 0.1, 99.0, 101.0), (5, None, "BUY", 0.1, 1.0, 2.0)]
    got = {r.id: r for r in decisions.levels(spark.createDataFrame(rows, "id int, c double, action string, atr double, support double, resistance double")).collect()}
    assert (got[1].viable, got[1].target, got[1].stop) == (True, 101.5, 99.2)
    assert [got[k].viable for k in (2, 4, 5)] == [False] * 3 and got[2].target is None
    assert got[3].viable and got[3].target == 98.5


def test_strategies_split_by_name(spark):
    df = spark.createDataFrame([(1, [("RSI", "BUY", 2.0), ("MACD line", "SELL", 3.0), ("ATR", "BUY", 9.0)], 0.0)], f"id int, factors {FACTOR}, chg double")
    got = {r.strategy: (r.available, r.action) for r in trend.by_strategy(df, "chg").collect()}
    assert got == {"momentum": (True, "SELL"), "reversion": (True, "BUY"), "session": (False, None), "imbalance": (False, None)}


def test_regrade_leaves_resolved_rows(spark):
    bars = spark.createDataFrame([("A", 0, 100.0, 100.0, 100.0), ("A", 60_000, 111.0, 99.0, 110.0)], "symbol string, ts_ms long, h double, l double, c double")
    rows = [("x", "A", 0, "BUY", 100.0, 110.0, 90.0), ("y", "A", 0, "BUY", 100.0, 110.0, 90.0), ("z", "A", 0, "BUY", 100.0, 150.0, 50.0)]
    log = spark.createDataFrame(rows, "sid string, symbol string, ts_ms long, action string, entry double, target double, stop double")
    log = log.withColumns({"status": F.when(F.col("sid") == "x", "stop").otherwise("pending"), "resolved_price": F.lit(None).cast("double"), "resolved_ms": F.lit(None).cast("long"), "mfe": F.lit(11.0), "mae": F.lit(-1.0)})
    got = {r.sid: (r.status, r.changed) for r in grading.regrade(log, bars, now_ms=120_000).collect()}
    assert got == {"x": ("stop", False), "y": ("target", True), "z": ("pending", False)}
