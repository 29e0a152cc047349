import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.functions import options
from candlemill.operators import option_trades

RATE = 0.065


def _price(f, k, t, v, call):
    """By numerical integration of the payoff over the lognormal forward."""
    n, total = 40000, 0.0
    for i in range(n):
        z = -8 + 16 * (i + 0.5) / n
        s = f * math.exp(v * math.sqrt(t) * z - v * v * t / 2)
        total += max(0.0, s - k if call else k - s) * math.exp(-z * z / 2)
    return math.exp(-RATE * t) * total * 16 / n / math.sqrt(2 * math.pi)


def test_price_delta_and_implied(spark):
    rows = [(24438.0, 24400.0, 5 / 365, 0.12, True), (24438.0, 24700.0, 20 / 365, 0.2, False), (24438.0, 24200.0, 30 / 365, 0.3, True)]
    df = spark.createDataFrame(rows, "f double, k double, t double, v double, call boolean")
    df = df.withColumn("m", options.black76(RATE)("f", "k", "t", "v", "call")).select("*", "m.*").drop("m")
    for r in df.withColumn("iv", options.implied_vol(RATE)("price", "f", "k", "t", "call")).collect():
        assert r.price == pytest.approx(_price(r.f, r.k, r.t, r.v, r.call), abs=0.01)
        up, down = (_price(r.f + e, r.k, r.t, r.v, r.call) for e in (1, -1))
        assert r.delta == pytest.approx(abs(up - down) / 2, abs=1e-3)
        assert r.iv == pytest.approx(r.v, abs=1e-9)
        assert r.theta > 0


def test_edges(spark):
    rows = [(100.0, 90.0, 0.0, 0.2, True, 10.0), (100.0, 90.0, 0.1, 0.2, True, 5.0), (100.0, 90.0, 0.1, 0.2, False, 0.0), (100.0, 100.0, 0.1, 0.2, None, None)]
    df = spark.createDataFrame(rows, "f double, k double, t double, v double, call boolean, p double")
    out = df.select(options.black76(RATE)("f", "k", "t", "v", "call").alias("m"), options.implied_vol(RATE)("p", "f", "k", "t", "call").alias("iv")).collect()
    assert (out[0].m.price, out[0].m.delta, out[0].m.theta) == (10.0, 1.0, 0.0)
    assert [r.iv for r in out] == [None] * 4  # expired, at or below intrinsic, no premium, unknown


def test_implied_takes_few_prices_and_gives_what_halving_gives(monkeypatch):
    rng = np.random.default_rng(4)
    n = 4000
    f, k, t, v = rng.uniform(50, 150, n), rng.uniform(50, 150, n), rng.uniform(0.001, 2, n), rng.uniform(0.01, 3, n)
    call = rng.random(n) < 0.5
    p = options.measures(f, k, t, v, call, RATE)[0]
    priced, plain = [], options.measures
    monkeypatch.setattr(options, "measures", lambda *a: (priced.append(len(a[0])), plain(*a))[1])
    got = options.implied(p, f, k, t, call, RATE)
    assert sum(priced) < 20 * n
    low, high = np.full(n, 1e-4), np.full(n, 5.0)
    for _ in range(80):
        mid = (low + high) / 2
        under = plain(f, k, t, mid, call, RATE)[0] < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    want = (low + high) / 2
    decay = plain(f, k, t, want, call, RATE)[2]
    seen = ~np.isnan(got) & (decay * 730 * t / want > 1e-3)  # beyond, prices hardly tell volatilities apart
    assert seen.sum() > 2000 and np.abs(got - want)[seen].max() < 1e-9
    back = plain(f, k, t, np.where(np.isnan(got), v, got), call, RATE)[0]
    assert np.abs(back - p).max() < 1e-10


def test_a_chain_is_solved_once(spark):
    """A filter on the volatility does not solve it again below."""
    chain = spark.range(8).selectExpr("100.0 forward", "96.0 + id strike", "0.1D years", "3.0 + 4 - id / 2 bid", "3.2 + 4 - id / 2 ask", "id % 2 = 0 is_call")
    chain = chain.select(*(F.col(c).cast("boolean" if c == "is_call" else "double").alias(c) for c in chain.columns))
    measured = option_trades.measure(chain, RATE)
    assert measured._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = measured.collect()
    assert rows and all(abs(float(options.measures(r.forward, r.strike, r.years, r.iv, r.is_call, RATE)[0]) - r.mid) < 1e-9 and r.cost_pts > 0 for r in rows)
