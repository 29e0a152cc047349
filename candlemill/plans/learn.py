"""Registered queries of the learned filter; scores are a model's own, so none has SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlemill.operators import learn, regime
from candlemill.plans.market import query, rounded
from candlemill.sources.shared import written
from candlemill.sources.testdata import load, volatility

FEATURES, ORDER = ["quantity", "price", "discount", "line"], ["day", "id", "line"]


def _samples(spark, d):
    """Line items as samples, labelled by whether the item came back."""
    t = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("double").alias("line"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), (F.col("l_tax") * 100 - F.col("l_discount") * 100).alias("pts"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )
    return regime.with_previous_close(t, volatility(spark, d))


@query()
def f22_walk_forward(spark, d):
    """AUC of each fold and seed, and of the fifth that the model rates highest the mean points; a model's scores are few, so counts by score tell both."""
    by = ["fold", "seed"]
    s = learn.walk_forward(_samples(spark, d).drop("vix"), FEATURES, ORDER, seeds=(0, 1))
    c = written(s.groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"), F.sum("pts").alias("pts"), F.count("pts").alias("told")), "by-score")
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("n").over(Window.partitionBy(*by))
    # from the least score that four fifths do not exceed
    kept = c.withColumn("upto", upto).withColumn("every", every).where(F.col("upto") >= F.greatest(F.ceil(0.8 * F.col("every")), F.lit(1)))
    kept = kept.groupBy(*by).agg(F.sum("n").alias("kept"), (F.sum("pts") / F.sum("told")).alias("pts"))
    return rounded(regime.auc_of_counts(c, by).join(kept, by))


@query()
def f23_importances(spark, d):
    return rounded(learn.importances(_samples(spark, d), FEATURES, 0), 4)


@query()
def e31_gate_then_filter(spark, d):
    """The filter validated on calm days only."""
    s = learn.walk_forward(learn.gated(_samples(spark, d), 16.0), FEATURES, ORDER)
    return rounded(regime.auc(s, ["fold"]))
