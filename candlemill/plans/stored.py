"""Registered queries over the stored archive: pulls of two intervals and segments, read back by series, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.plans.market import ROUND, query, rounded
from candlemill.sources.shared import shared_path
from candlemill.sources.store import KEY, BarStore
from candlemill.sources.testdata import BARS, MS, bars

HOUR_MS, AGAIN_MS, FROM_MS, TO_MS = 3_600_000, 1_705_276_800_000, 1_704_412_800_000, 1_705_276_800_000
SEGMENT = "CASE WHEN symbol IN ('purchase', 'error') THEN 'EQUITY' ELSE 'INDEX' END"


def _pull(spark, d):
    """Bars of 15 minutes and of an hour, of symbols in two segments."""
    both = bars(spark, d).withColumn("interval", F.lit("15m")).unionByName(bars(spark, d, HOUR_MS).withColumn("interval", F.lit("1h")))
    return both.withColumn("segment", F.expr(SEGMENT))


def _again(b):
    """A later pull: the end of the archive with other closes, and each series' next bar."""
    new = b.where(F.col("ts_ms") >= AGAIN_MS).withColumn("c", F.col("c") + 1)
    step = F.when(F.col("interval") == "1h", HOUR_MS).otherwise(900_000)
    following = new.groupBy(*KEY[:3]).agg(F.max("ts_ms").alias("at")).withColumn("ts_ms", (F.col("at") + step).cast("long"))
    return new.unionByName(following.select(*KEY, *(F.lit(100.0).alias(c) for c in "ohlc"), F.lit(1.0).alias("v")))


def _store(spark, d, pulls: int = 1) -> BarStore:
    store, first = BarStore(spark, shared_path(spark, "archive")), _pull(spark, d)
    store.write(first, "feed", 1)
    if pulls > 1:
        store.write(_again(first), "other", 2)
    return store


WHOLE = "symbol IS NOT NULL AND NOT (isnan(o) OR isnan(h) OR isnan(l) OR isnan(c))"  # the store keeps no row without a key or a price
STORED = f"""{BARS}, hourly AS (SELECT event_type AS symbol, CAST(floor({MS} / {HOUR_MS}) AS BIGINT) * {HOUR_MS} AS ts_ms,
  first(value ORDER BY ts, event_id NULLS FIRST, value) + 100 AS o, max(value) + 100 AS h, min(value) + 100 AS l, last(value ORDER BY ts, event_id NULLS FIRST, value) + 100 AS c, CAST(count(*) AS DOUBLE) AS v
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
feed AS (SELECT symbol, {SEGMENT} AS segment, interval, ts_ms, o, h, l, c, v FROM (SELECT *, '15m' AS interval FROM bars UNION ALL SELECT *, '1h' FROM hourly)), stored AS (SELECT * FROM feed WHERE {WHOLE})"""
AGAIN = f"""{STORED}, changed AS (SELECT symbol, segment, interval, ts_ms, o, h, l, c + 1 AS c, v FROM feed WHERE ts_ms >= {AGAIN_MS}),
pull AS (SELECT * FROM (SELECT * FROM changed UNION ALL SELECT symbol, segment, interval, max(ts_ms) + CASE WHEN interval = '1h' THEN {HOUR_MS} ELSE 900000 END, 100, 100, 100, 100, 1 FROM changed GROUP BY symbol, segment, interval) WHERE {WHOLE})"""


@query(f"WITH {STORED} SELECT ts_ms, {ROUND('o', 'h', 'l', 'c', 'v')} FROM stored WHERE symbol = 'view' AND segment = 'INDEX' AND interval = '15m' AND ts_ms BETWEEN {FROM_MS} AND {TO_MS}")
def a1_stored_range(spark, d):
    """One series' range: only its months are read."""
    return rounded(_store(spark, d).read("view", "INDEX", "15m", FROM_MS, TO_MS).drop("oi"))


@query(f"WITH {STORED}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, segment, interval ORDER BY ts_ms DESC) AS k FROM stored) SELECT symbol, segment, interval, ts_ms, {ROUND('o', 'h', 'l', 'c', 'v')} FROM k WHERE k <= 375")
def a2_stored_latest(spark, d):
    return rounded(_store(spark, d).latest(375).select(*KEY, *"ohlcv"))


@query(f"WITH {AGAIN} SELECT symbol, segment, interval, ts_ms, source, {ROUND('o', 'h', 'l', 'c', 'v')} FROM (SELECT *, 'other' AS source FROM pull UNION ALL SELECT *, 'feed' FROM stored WHERE (symbol, segment, interval, ts_ms) NOT IN (SELECT symbol, segment, interval, ts_ms FROM pull))")
def a3_stored_upsert(spark, d):
    """Two pulls; the later one replaces the bars of its keys and leaves other partitions alone."""
    return rounded(_store(spark, d, 2).bars().select(*KEY, "source", *"ohlcv"))


@query(f"""WITH {AGAIN} SELECT symbol, segment, interval, 'feed' AS source, CAST(1 AS BIGINT) AS synced_at, count(*) AS rows_added, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts FROM stored GROUP BY symbol, segment, interval
UNION ALL SELECT symbol, segment, interval, 'other', 2, sum(CASE WHEN (symbol, segment, interval, ts_ms) IN (SELECT symbol, segment, interval, ts_ms FROM stored) THEN 0 ELSE 1 END), min(ts_ms), max(ts_ms) FROM pull GROUP BY symbol, segment, interval""")
def a3_sync_log(spark, d):
    """The log of both pulls, a row a series and pull."""
    return _store(spark, d, 2).log()


@query(f"WITH {STORED} SELECT 'click' AS symbol, 'INDEX' AS segment, '1h' AS interval, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM stored WHERE symbol = 'click' AND segment = 'INDEX' AND interval = '1h'")
def a4_stored_coverage(spark, d):
    return _store(spark, d).coverage("click", "INDEX", "1h")


@query(f"WITH {STORED} SELECT symbol, segment, interval, count(*) AS n, CAST(make_timestamp((min(ts_ms) + 19800000) * 1000) AS DATE) AS first_day, CAST(make_timestamp((max(ts_ms) + 19800000) * 1000) AS DATE) AS last_day FROM stored GROUP BY symbol, segment, interval")
def a5_stored_inventory(spark, d):
    return _store(spark, d).inventory()
