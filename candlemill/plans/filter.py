"""Registered queries of the learned filter over graded signals and their features; scores are a model's own, so none has SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.operators import boost, decisions, grading, regime
from candlemill.plans.features import called_bars
from candlemill.plans.market import query, rounded
from candlemill.sources.shared import written
from candlemill.sources.testdata import bars, volatility

ORDER, SEEDS, KEEPS = ["ts_ms", "symbol"], (0, 1, 2), (0.5, 0.4, 0.3, 0.2, 0.1)


def samples(spark, d):
    """(symbol, ts_ms, features, label, pts) of one signal a bar, to the side that its vote leans to, with target and stop a range away, as far as either was touched.

    The tables' bars are too wide for a viable call, so levels are the range's and not the call's; features
    are those of the signal taken, in the models' order.
    """
    b = bars(spark, d)
    way = F.when(F.col("buy_w") >= F.col("sell_w"), 1.0).otherwise(-1.0)
    a = called_bars(b, volatility(spark, d)).where("atr > 0")
    a = a.withColumns({"action": F.when(way > 0, "BUY").otherwise("SELL"), "target": F.col("c") + way * F.col("atr"), "stop": F.col("c") - way * F.col("atr"), "rr": F.lit(1.0)})
    a = written(a, "signals")
    signals = a.select(F.concat_ws("/", "symbol", "ts_ms").alias("sid"), "symbol", "ts_ms", "action", F.col("c").alias("entry"), "target", "stop")
    graded = grading.grade(signals, b).where("status in ('target', 'stop')")
    said = graded.select("symbol", "ts_ms", (F.col("status") == "target").cast("int").alias("label"), ((F.col("resolved_price") - F.col("entry")) * F.when(F.col("action") == "BUY", 1.0).otherwise(-1.0)).alias("pts"))
    rows = decisions.features(a)
    return rows.select("symbol", "ts_ms", F.array(*decisions.FEATURES).alias("features")).join(said, ["symbol", "ts_ms"])


def _scored(spark, d, seeds=SEEDS):
    """Scores of all samples, written as the samples are: both are gone through several times."""
    return written(boost.walk_forward(written(samples(spark, d), "samples"), ORDER, seeds), "scored")


@query()
def f22_signal_filter(spark, d):
    """AUC of each fold, its trades and mean points, and those that the filter keeps at each share, by thresholds of the fold's past."""
    s = _scored(spark, d, (7,))
    base = s.where("test").groupBy("of").agg(F.count("*").alias("trades"), F.avg("pts").alias("pts")).join(regime.auc(s.where("test"), ["of"]), "of")
    own = boost.kept(s, KEEPS).groupBy("of", "keep").agg(F.count("*").alias("kept"), F.avg("pts").alias("kept_pts"))
    every = base.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in KEEPS], "keep double")))
    return rounded(every.join(own, ["of", "keep"], "left").select(F.col("of").alias("fold"), "keep", "auc", "trades", "pts", F.coalesce("kept", F.lit(0)).alias("kept"), "kept_pts"))


@query()
def f23_signal_importances(spark, d):
    """Each feature's share of the gain in the last fold's model."""
    s = regime.folds(written(samples(spark, d), "samples"), [], ORDER)
    gains = boost.importances(boost.models(s, ORDER, 4, (7,)), decisions.FEATURES).where("of = 3")
    return rounded(gains.select("feature", "gain_pct"), 4)


@query()
def e24_seed_robustness(spark, d):
    """Spread over seeds of the mean points of what each keeps, and whether every one gains."""
    s = boost.kept(_scored(spark, d), KEEPS).groupBy("keep", "seed").agg(F.avg("pts").alias("net"))
    agg = s.groupBy("keep").agg(F.count("*").alias("seeds"), F.avg("net").alias("mean"), F.stddev_pop("net").alias("sd"), F.min("net").alias("worst"), F.max("net").alias("best"), F.count(F.when(F.col("net") > 0, 1)).alias("positive"))
    return rounded(agg.withColumn("robust", (F.col("positive") == F.col("seeds")) & (F.col("worst") > 0)))


@query()
def e25_filter_selection(spark, d):
    """Signals that most seeds keep out of sample."""
    return boost.selection(_scored(spark, d), ORDER, 0.5, len(SEEDS))


@query()
def e31_filter_after_gate(spark, d):
    """The filter validated on signals of small ranges alone, and on all of them: the loose pool."""
    s, out = written(samples(spark, d), "samples"), None
    at = s.select(F.percentile_approx(F.get("features", F.lit(decisions.FEATURES.index("atr_pct"))), 0.75).alias("gate")).first()["gate"]
    for pool, own in (("gated", s.where(F.get("features", F.lit(decisions.FEATURES.index("atr_pct"))) <= (at or 0.0))), ("all", s)):
        auc = regime.auc(boost.walk_forward(own, ORDER, (7,)).where("test"), ["of"]).select(F.lit(pool).alias("pool"), F.col("of").alias("fold"), "auc")
        out = auc if out is None else out.unionByName(auc)
    return rounded(out)
