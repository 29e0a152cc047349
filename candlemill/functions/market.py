"""Scalar rules of the trading day and of a single trade, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IST_MS, DAY_MS = 19_800_000, 86_400_000
#: Minutes of the day: open, square-off, close.
OPEN, SQUARE_OFF, CLOSE = 555, 920, 930


def session_day(ts_ms: Column) -> Column:
    """Day number of a UTC instant at +05:30."""
    return F.floor((ts_ms + IST_MS) / DAY_MS).cast("int")


def day_minutes(ts_ms: Column) -> Column:
    return F.floor(F.pmod(ts_ms + IST_MS, F.lit(DAY_MS)) / 60_000).cast("int")


def percent(a: Column, b: Column) -> Column:
    return F.when(b != 0, (a - b) / b * 100).otherwise(0.0)


def market_status(weekday: Column, minutes: Column, holiday: Column) -> Column:
    """weekday counts from Monday = 0."""
    return (
        F.when(weekday >= 5, "weekend").when(holiday, "holiday").when(minutes < OPEN, "pre_open").when(minutes > CLOSE, "post_close").otherwise("open")
    )


def strength(confidence: Column) -> Column:
    return F.when(confidence >= 90, "Very Strong").when(confidence >= 85, "Strong").otherwise("High")


def option_buy_cost(entry: Column, exit_: Column, units: int = 75, ticks: float = 1.0) -> Column:
    """Rupees of a bought and sold option: brokerage, duties, taxes, slippage."""
    buy, sell = entry * units, exit_ * units
    exchange, sebi = (buy + sell) * 0.0003503, (buy + sell) * 0.000001
    return 40.0 + sell * 0.001 + exchange + sebi + buy * 0.00003 + (40.0 + exchange + sebi) * 0.18 + ticks * 0.05 * units * 2


def intraday_cost(entry: Column, exit_: Column, units: int = 1) -> Column:
    """Rupees of an equity round trip within a day."""
    buy, sell = entry * units, exit_ * units
    brokerage = F.least(buy * 0.0003, F.lit(20.0)) + F.least(sell * 0.0003, F.lit(20.0))
    exchange, sebi = (buy + sell) * 0.0000297, (buy + sell) * 0.000001
    return brokerage + sell * 0.00025 + exchange + sebi + buy * 0.00003 + (brokerage + exchange + sebi) * 0.18 + (buy + sell) * 0.0005
