"""Trades priced again as bought options, and the measures and choice of a chain's strikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions import options
from candlemill.functions.market import option_buy_cost
from candlemill.functions.quantile import at_shares

# Days to expiry, spread in points, units of a lot, tick, and the hold of a trade without one in hours.
DAYS, SPREAD, LOT, TICK, HOLD = 4.7, 0.60, 75, 0.05, 6.0


def price_trades(trades: DataFrame, rate: float, index: float = 24000.0) -> DataFrame:
    """trades(pts, hold_hours, iv) with entry, exit and delta of a call struck at the entry, and its gross, cost, theta, gamma in premium and net in index points.

    pts is signed in the trade's favour, so puts need no other treatment. Trades without iv, or with
    no premium to pay, go. Time passes first and the index moves then, so theta and gamma add up.
    """
    price = options.black76(rate)
    t = trades.where("iv is not null").withColumn("hold_hours", F.when(F.col("hold_hours") > 0, F.col("hold_hours")).otherwise(HOLD))
    strike, call, t0 = F.lit(index), F.lit(True), F.lit(DAYS / 365)
    t1 = F.greatest(t0 - F.col("hold_hours") / 24 / 365, F.lit(1e-6))
    at = lambda f, years: price(f, strike, years, F.col("iv"), call)
    t = t.withColumns({"__a": at(F.lit(index), t0), "__b": at(index + F.col("pts"), t1), "__c": at(F.lit(index), t1)})
    t = t.where("__a.price > 0 and __a.delta > 0.01")
    cost = option_buy_cost(F.col("__a.price"), F.greatest("__b.price", F.lit(0.0)), LOT, SPREAD / 2 / TICK) / LOT
    gross, theta = F.col("__b.price") - F.col("__a.price"), F.col("__c.price") - F.col("__a.price")
    t = t.withColumns({"entry": F.col("__a.price"), "exit": F.col("__b.price"), "delta": F.col("__a.delta"), "gross": gross, "theta": theta, "gamma": gross - theta - F.col("pts") * F.col("__c.delta"), "cost": cost})
    return t.withColumn("net_pts", (F.col("gross") - F.col("cost")) / F.col("delta")).drop("__a", "__b", "__c")


def repriced(priced: DataFrame, by: list[str]) -> DataFrame:
    """Means of priced trades in index points, and the median hold."""
    pts = lambda c, sign=1: F.avg(sign * F.col(c) / F.col("delta"))
    means = priced.groupBy(*by).agg(
        F.count("*").alias("trades"), F.avg("pts").alias("index_net"), F.avg("net_pts").alias("option_net"),
        pts("theta").alias("theta_pts"), pts("gamma").alias("gamma_pts"), pts("cost", -1).alias("cost_pts"), F.sum("net_pts").alias("total_net"),
    )
    return means.join(at_shares(priced, by, "hold_hours", {"median_hold": 0.5}, middle=True), by)


def measure(chain: DataFrame, rate: float) -> DataFrame:
    """chain(forward, strike, years, bid, ask, is_call) with mid, iv, delta, theta, and spread, charges and cost in points; strikes without an iv go."""
    mid = (F.col("bid") + F.col("ask")) / 2
    d = chain.where("bid > 0 and ask > 0").withColumn("mid", mid).withColumn("m", options.chain_measures(rate)("mid", "forward", "strike", "years", "is_call")).where("m.iv is not null")
    d = d.withColumns({"iv": F.col("m.iv"), "delta": F.col("m.delta"), "theta": F.col("m.theta"), "spread": F.col("ask") - F.col("bid")}).drop("m")
    d = d.withColumn("charges", option_buy_cost(F.col("mid"), F.col("mid"), LOT, 0.0) / LOT)
    return d.withColumn("cost_pts", F.when(F.col("delta") > 0, (F.col("spread") + F.col("charges")) / F.col("delta")))


def cheapest(measured: DataFrame, by: list[str], low: float = 0.35, high: float = 0.70) -> DataFrame:
    """The strike of each chain and side that costs least of those with volume and a delta in range; the lower strike of equals."""
    ok = measured.where(F.col("delta").between(low, high) & (F.col("volume") > 0))
    k = F.row_number().over(Window.partitionBy(*by, "is_call").orderBy("cost_pts", "strike"))
    return ok.withColumn("__k", k).where("__k = 1").drop("__k")
