"""Registered queries of averages over the trailing window of 375 bars, with SQL that folds every window."""

from __future__ import annotations

from candlemill.functions.scan import trailing, trailing_line
from candlemill.plans.market import query, rounded
from candlemill.sources.testdata import BARS, bars

WINDOW = 375
_HELD = f"{BARS}, w AS (SELECT symbol, ts_ms, list(c) OVER (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS x FROM bars)"
_K = {p: 2.0 / (p + 1) for p in (9, 12, 20, 26, 50)}
_fold = lambda p: f"list_reduce(x, lambda y, v: y * (1 - {_K[p]!r}) + v * {_K[p]!r})"


@query(f"WITH {_HELD} SELECT symbol, ts_ms, round({_fold(20)}, 6) AS ema_20, round({_fold(50)}, 6) AS ema_50 FROM w")
def c1_trailing_ema(spark, d):
    """Averages that see the last 375 bars only, as each step of a replay does."""
    b = trailing(bars(spark, d), "c", 20, WINDOW, "ema_20")
    return rounded(trailing(b, "c", 50, WINDOW, "ema_50").select("symbol", "ts_ms", "ema_20", "ema_50"))


@query(f"""WITH {_HELD}, r AS (SELECT symbol, ts_ms, list_reduce(list_transform(x, lambda v: {{'x': v, 'f': v, 's': v, 'g': 0.0::DOUBLE}}), lambda y, v: {{'x': v.x, 'f': y.f * (1 - {_K[12]!r}) + v.x * {_K[12]!r}, 's': y.s * (1 - {_K[26]!r}) + v.x * {_K[26]!r},
 'g': y.g * (1 - {_K[9]!r}) + (y.f * (1 - {_K[12]!r}) + v.x * {_K[12]!r} - y.s * (1 - {_K[26]!r}) - v.x * {_K[26]!r}) * {_K[9]!r}}}) AS r FROM w)
SELECT symbol, ts_ms, round(r.f - r.s, 6) AS line, round(r.g, 6) AS signal FROM r""")
def c3_trailing_macd(spark, d):
    b = trailing_line(bars(spark, d), "c", 12, 26, 9, WINDOW)
    return rounded(b.select("symbol", "ts_ms", "line", "signal"))
