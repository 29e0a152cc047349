import random

import pytest
from pyspark.sql import functions as F

from candlemill.functions import quantile
from candlemill.operators import grading, regime, signals


def test_shares_equal_sorted_values(spark, monkeypatch):
    """Ties, nulls, one-row groups and brackets narrower than the group."""
    monkeypatch.setattr(quantile, "ACCURACY", 200)
    r = random.Random(3)
    rows = [("a", float(r.randint(0, 3000))) for _ in range(4001)] + [("b", 1.0)] * 6 + [("b", 2.0)] * 6 + [("c", 5.0), ("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: x for x in quantile.at_shares(df, ["g"], "v", {"low": 0.1, "high": 0.8}).collect()}
    mid = {x.g: x.m for x in quantile.at_shares(df, ["g"], "v", {"m": 0.5}, middle=True).collect()}
    assert set(got) == set(mid) == {"a", "b", "c"}
    for g in got:
        v = sorted(x for k, x in rows if k == g and x is not None)
        place = lambda p: v[max(0, -(-int(p * 10) * len(v) // 10) - 1)]
        assert (got[g].low, got[g].high) == (place(0.1), place(0.8))
        assert mid[g] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    whole = quantile.at_shares(df, [], "v", {"m": 0.5}, middle=True).first().m
    v = sorted(x for _, x in rows if x is not None)
    assert whole == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert quantile.at_shares(df.where("false"), ["g"], "v", {"m": 0.5}).count() == 0


def test_rows_are_never_broadcast(spark, tmp_path):
    """Rows multiplied out of a small file stay where they are; their groups' sizes are what is sent."""
    spark.range(100).select((F.col("id") % 10).cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    many = spark.read.parquet(str(tmp_path / "t")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(99))))
    out = quantile.at_shares(many, ["g"], "v", {"m": 0.5})
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and "BuildRight" in plan
    assert {(r.g, r.m) for r in out.collect()} == {(k, 4.0) for k in range(100)}


@pytest.mark.parametrize("edges", [(50.0, 60.0), (1.0, 2.0), (90.0, 95.0)])
def test_a_missed_bracket_is_an_error(spark, monkeypatch, edges):
    """A bracket that lies above or below its rank never gives a value."""
    df = spark.createDataFrame([("g", float(k)) for k in range(100)], "g string, v double")
    given = iter(edges * 2)
    monkeypatch.setattr(quantile, "_edge", lambda p: F.max(F.lit(next(given))))
    for share, middle in ((0.3, False), (0.3, True)):
        with pytest.raises(Exception, match="missed its rank"):
            quantile.at_shares(df, ["g"], "v", {"m": share}, middle).collect()


def test_rows_are_numbered_across_days(spark):
    rows = [(k % 3, k % 7, k) for k in range(200)] + [(1, None, 500)]
    df = spark.createDataFrame(rows, "g long, day long, k long")
    got = {x.k: (x.i, x.n) for x in regime.numbered(df, ["g"], ["day", "k"]).collect()}
    for g in range(3):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[x[2]] for x in own] == [(i, len(own)) for i in range(len(own))]
    assert regime.numbered(df, [], ["day", "k"]).agg(F.max("i")).first()[0] == 200


def test_merge_walks_long_runs_of_one_confidence(spark):
    """Against the rule read row by row, with confidences of few values and gaps on both sides of the limit."""
    r, rows, at = random.Random(5), [], 0
    for _ in range(600):
        at += r.choice([1, 5, 5, 7, 20, 21]) * 60_000
        rows.append(("s", at, r.choice(["BUY"] * 9 + ["SELL"]), r.choice([50.0] * 5 + [60.0]), float(at), 0.0, 0.0))
    want = []
    for _, ts, action, conf, entry, _, _ in rows:
        head = want[-1] if want else None
        if head is None or head["action"] != action or ts - head["ts"] > signals.GAP_MS:
            want.append({"action": action, "first": ts, "ts": ts, "n": 1, "conf": conf, "peak": conf, "entry": entry})
        elif conf != head["conf"]:
            head.update(ts=ts, n=head["n"] + 1, conf=conf, peak=max(head["peak"], conf), entry=entry)
    got = signals.merge_signals(spark.createDataFrame(rows, "symbol string, ts_ms long, action string, confidence double, entry double, target double, stop double")).orderBy("first_ms").collect()
    assert [(x.action, x.first_ms, x.ts_ms, x.updates, x.confidence, x.peak, x.entry) for x in got] == [tuple(w.values()) for w in want]


def test_drawdown_over_hours_equals_the_walk(spark):
    r = random.Random(9)
    rows = [(str(k), r.randint(0, 40) * 900_000, "BUY", "target", 10.0, 10.0 + r.choice([-3.0, -1.0, 2.0, 0.0])) for k in range(400)]
    df = spark.createDataFrame(rows, "sid string, ts_ms long, action string, status string, entry double, resolved_price double")
    got = grading.summarize(df, ["action"], 0.25).first()
    equity = peak = drop = 0.0
    for x in sorted(rows, key=lambda x: (x[1], x[0])):
        equity += x[5] - x[4] - 0.25
        peak = max(peak, equity)
        drop = max(drop, peak - equity)
    assert (got.resolved, got.total_net, got.max_drawdown) == (400, pytest.approx(equity), pytest.approx(drop))
