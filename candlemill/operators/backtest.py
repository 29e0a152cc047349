"""A replay of readings with hooks: what a column lets through, a volatility gate and a score are applied before signals merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.operators.grading import DAY_WINDOW_MS, grade
from candlemill.operators.signals import GAP_MS, merge_signals


def passed(readings: DataFrame, signal_filter: Column | None = None, volatility: Column | None = None, gate: float | None = None, score: Column | None = None, least_score: float | None = None, least_confidence: float = 0.0) -> DataFrame:
    """Readings that every hook lets through: columns over the readings' own, null standing for no.

    A volatility above gate and a score below least_score turn a reading away; without a bound the hook
    does nothing.
    """
    ok = F.col("confidence") >= least_confidence
    if signal_filter is not None:
        ok &= signal_filter
    if volatility is not None and gate is not None:
        ok &= volatility <= gate
    if score is not None and least_score is not None:
        ok &= score >= least_score
    return readings.where(F.coalesce(ok, F.lit(False)))


def backtest(readings: DataFrame, bars: DataFrame, gap_ms: int = GAP_MS, window_ms: int = DAY_WINDOW_MS, now_ms=None, min_points: float = 0.0, **hooks) -> DataFrame:
    """Signals merged from readings(symbol, ts_ms, action, confidence, entry, target, stop) that pass the hooks, graded on bars.

    A reading that is turned away takes no slot: it neither opens a signal nor keeps a later one from opening.
    """
    merged = merge_signals(passed(readings, **hooks).select("symbol", "ts_ms", "action", "confidence", "entry", "target", "stop"), gap_ms)
    signals = merged.withColumn("sid", F.concat(F.col("first_ms").cast("string"), "symbol")).withColumns({"stored_ms": F.col("ts_ms"), "ts_ms": F.col("first_ms")})
    return grade(signals, bars, window_ms, now_ms, min_points)
