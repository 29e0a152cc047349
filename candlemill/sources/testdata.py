"""Bars, daily bars and daily readings built from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_MS, BASE = 900_000, 100.0
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(col: str):
    """Milliseconds begun of a zone-less timestamp, by differences only; before 1970 too."""
    us = f"timestampdiff(MICROSECOND, {EPOCH}, {col})"
    return F.expr(f"({us} - pmod({us}, 1000)) div 1000")


#: The same in SQL: DuckDB's own epoch_ms takes the nearest millisecond, which at a bar's end is the next bar's first.
MS = "((epoch_us(ts) - (epoch_us(ts) % 1000 + 1000) % 1000) // 1000)"


def bars(spark: SparkSession, sf_dir: str, bar_ms: int = BAR_MS) -> DataFrame:
    """(symbol, ts_ms, o, h, l, c, v): one symbol an event type, prices offset by BASE."""
    e = load(spark, sf_dir, "events").where("ts is not null and value is not null")
    at = (F.floor(epoch_ms("ts") / bar_ms) * bar_ms).cast("long")
    key = F.struct("ts", "event_id", "value")  # ids may repeat where tables are put together
    return e.groupBy(F.col("event_type").alias("symbol"), at.alias("ts_ms")).agg(
        (F.min_by("value", key) + BASE).alias("o"),
        (F.max("value") + BASE).alias("h"),
        (F.min("value") + BASE).alias("l"),
        (F.max_by("value", key) + BASE).alias("c"),
        F.count("*").cast("double").alias("v"),
    )


BARS = f"""bars AS (SELECT event_type AS symbol, CAST(floor({MS} / {BAR_MS}) AS BIGINT) * {BAR_MS} AS ts_ms,
  first(value ORDER BY ts, event_id NULLS FIRST, value) + 100 AS o, max(value) + 100 AS h, min(value) + 100 AS l,
  last(value ORDER BY ts, event_id NULLS FIRST, value) + 100 AS c, CAST(count(*) AS DOUBLE) AS v
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, day, o, h, l, c, v): one symbol a return flag."""
    key = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(
        F.min_by("l_extendedprice", key).alias("o"),
        F.max("l_extendedprice").alias("h"),
        F.min("l_extendedprice").alias("l"),
        F.max_by("l_extendedprice", key).alias("c"),
        F.sum("l_quantity").alias("v"),
    )


DAILY = """daily AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day,
  first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS o, max(l_extendedprice) AS h, min(l_extendedprice) AS l,
  last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS c, sum(l_quantity) AS v
  FROM lineitem GROUP BY 1, 2)"""


def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, close): the day's mean order price, scaled to the usual range of a volatility index."""
    return load(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice") / 10000, 6).alias("close"))


VIX = "vix AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) / 10000, 6) AS close FROM orders GROUP BY 1)"
