"""Registered queries of the library's surface: a replay with hooks, and setups as table functions of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.functions.tables import register
from candlemill.operators import backtest, indicators, signals
from candlemill.plans import replays  # noqa: F401 - its supertrend's SQL is this one's too
from candlemill.plans.market import MERGED, ORACLE, READINGS, ROUND, graded_sql, query, rounded
from candlemill.sources.testdata import bars

LEAST, GATE = 18.0, 60.0
FILTERED = READINGS.replace("WHERE action IS NOT NULL", f"WHERE action IS NOT NULL AND abs(rsi - 50) >= {LEAST} AND vol_20 <= {GATE} AND c >= support") + MERGED[len(READINGS) :]


@query(f"WITH RECURSIVE {FILTERED}, {graded_sql()} SELECT symbol, first_ms, action, status, {ROUND('resolved_price', 'mfe', 'mae')} FROM graded")
def g17_filtered_replay(spark, d):
    """Signals of readings that are sure enough, calm and above support: what is turned away takes no slot."""
    b = bars(spark, d)
    i = indicators.with_indicators(b)
    readings = signals.band_signals(i).join(i.select("symbol", "ts_ms", "vol_20", "support"), ["symbol", "ts_ms"])
    out = backtest.backtest(readings, b, min_points=0.5, signal_filter=F.col("entry") >= F.col("support"), volatility=F.col("vol_20"), gate=GATE, least_confidence=LEAST)
    return rounded(out.select("symbol", "first_ms", "action", "status", "resolved_price", "mfe", "mae"))


@query(ORACLE["c13_supertrend"])
def c13_supertrend_sql(spark, d):
    """The supertrend as a table function, a partition a symbol."""
    register(spark)
    own = bars(spark, d)
    out = spark.sql("SELECT * FROM supertrend(TABLE(SELECT * FROM {bars}) PARTITION BY symbol ORDER BY ts_ms)", bars=own)
    return rounded(out)
