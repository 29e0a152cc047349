"""The bar archive: reading ranges, latest bars, coverage, and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["symbol", "ts_ms"]


def read_range(bars: DataFrame, symbol: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """One series, both ends included."""
    out = bars.where(F.col("symbol") == symbol)
    out = out if start_ms is None else out.where(F.col("ts_ms") >= start_ms)
    return out if end_ms is None else out.where(F.col("ts_ms") <= end_ms)


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts_ms")))
    return bars.withColumn("k", k).where(F.col("k") <= n).drop("k")


def inventory(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def clean(rows: DataFrame) -> DataFrame:
    """Landing rows without those that lack a price; a missing volume is none."""
    prices = [F.col(c).isNotNull() & ~F.isnan(c) for c in "ohlc"]
    return rows.where(prices[0] & prices[1] & prices[2] & prices[3]).withColumn("v", F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new rows put in: the later load wins a key. One aggregation, no sort."""
    rest = [c for c in old.columns if c not in KEY]
    both = old.withColumn("load", F.lit(0)).unionByName(new.withColumn("load", F.lit(1)))
    return both.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "load").alias("x")).select(*KEY, "x.*").select(old.columns)


def new_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of new that old lacks."""
    return new.select(KEY).distinct().join(old.select(KEY), KEY, "left_anti")


def clean_pages(pages: DataFrame) -> DataFrame:
    """(symbol, ts_ms, o, h, l, c, v) of pages(symbol, page, row) with row [seconds, o, h, l, c, v]; short or null rows go, the first page's copy of a time stays, of one page's the least row."""
    whole = pages.where(F.size("row") >= 6).withColumn("ts_ms", (F.element_at("row", 1) * 1000).cast("long")).where("ts_ms is not null")
    first = whole.groupBy("symbol", "ts_ms").agg(F.min_by("row", F.struct(F.col("page").isNull(), "page", "row")).alias("row"))
    return first.select("symbol", "ts_ms", *(F.element_at("row", k).alias(c) for k, c in enumerate("ohlcv", 2)))


_CHART = "timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"


def clean_charts(charts: DataFrame) -> DataFrame:
    """(symbol, ts_ms, o, h, l, c, v) of charts(symbol, body), body being JSON arrays matched by position.

    A missing price is 0, prices have two digits, volumes are whole, and bars without a close go.
    """
    x = charts.select("symbol", F.from_json("body", _CHART).alias("b")).select("symbol", F.inline(F.arrays_zip(*(F.col(f"b.{n}").alias(n) for n in ("timestamp", "open", "high", "low", "close", "volume")))))
    price = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    x = x.where("timestamp is not null").select("symbol", (F.col("timestamp") * 1000).alias("ts_ms"), *(price(a).alias(b) for a, b in zip(("open", "high", "low", "close"), "ohlc")), F.floor(F.coalesce("volume", F.lit(0.0))).alias("v"))
    return x.where("c > 0")
