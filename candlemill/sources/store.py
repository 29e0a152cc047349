"""The stored archive: bars by (symbol, segment, interval, ts_ms) in partitions, and a log of pulls.

Parquet under interval, symbol and month (of the day at +05:30), so a series' range is read from its own
months alone and a pull rewrites only the partitions that it touches. Within a partition rows lie
in order of time, so row groups outside a range are skipped too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from candlemill.functions.market import session_day
from candlemill.sources.archive import clean

SERIES = ["symbol", "segment", "interval"]
KEY = [*SERIES, "ts_ms"]
PARTITION = ["interval", "symbol", "month"]
BAR = "segment string, ts_ms long, o double, h double, l double, c double, v double, oi double, source string, interval string, symbol string, month int"
LOG = "symbol string, segment string, interval string, source string, synced_at long, rows_added long, first_ts long, last_ts long"


def _date(ts_ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), session_day(ts_ms))


def _month(ts_ms: Column) -> Column:
    return F.year(_date(ts_ms)) * 100 + F.month(_date(ts_ms))


class BarStore:
    """Bars under path/bars and pulls under path/log; both may be missing yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def bars(self) -> DataFrame:
        """Every bar with its key; filters on interval, symbol and month prune partitions."""
        return self._read("bars", BAR)

    def log(self) -> DataFrame:
        return self._read("log", LOG)

    def write(self, pull: DataFrame, source: str, synced_at: int) -> DataFrame:
        """Put in pull(KEY, o, h, l, c, v[, oi]): its rows replace those of their keys. Returns the log rows, one a series.

        Rows without a price or a key go, of rows of one key the largest (c, o, h, l, v) stays, an absent
        oi is null. Only the touched partitions are read and written again. A pull that is run again
        after a failure leaves the same bars, for it replaces its own rows; an empty one leaves no trace.
        """
        oi = F.col("oi").cast("double") if "oi" in pull.columns else F.lit(None).cast("double")
        rows = clean(pull.dropna(subset=KEY)).select(*KEY, *(F.col(c).cast("double").alias(c) for c in "ohlcv"), oi.alias("oi"))
        new = rows.groupBy(*KEY).agg(F.max(F.struct("c", "o", "h", "l", "v", "oi")).alias("x")).select(*KEY, "x.*")
        new = new.withColumn("source", F.lit(source)).withColumn("month", _month(F.col("ts_ms"))).persist()
        try:
            touched = new.select(PARTITION).distinct().collect()  # as many as partitions are rewritten
            if not touched:
                return self.spark.createDataFrame([], LOG)
            old = self.bars().where(_any_of(touched))
            both = old.withColumn("load", F.lit(0)).unionByName(new.withColumn("load", F.lit(1)))
            rest = ("o", "h", "l", "c", "v", "oi", "source")
            merged = both.groupBy(*KEY, "month").agg(F.max_by(F.struct(*rest), "load").alias("x"), (F.min("load") == 1).alias("added"), (F.max("load") == 1).alias("pulled"))
            merged = merged.select(*KEY, "month", "x.*", "added", "pulled").persist()
            try:
                said = merged.where("pulled").groupBy(*SERIES).agg(F.sum(F.col("added").cast("long")).alias("rows_added"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))
                said = said.withColumns({"source": F.lit(source), "synced_at": F.lit(synced_at).cast("long")}).select([c.split()[0] for c in LOG.split(", ")])
                said = self.spark.createDataFrame(said.collect(), LOG)  # a row a pulled series, counted before its partitions change
                out = merged.drop("added", "pulled").repartition(*PARTITION).sortWithinPartitions(*PARTITION, "segment", "ts_ms")
                out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(f"{self.path}/bars")
            finally:
                merged.unpersist()
        finally:
            new.unpersist()
        said.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return said

    def read(self, symbol: str, segment: str, interval: str, start_ms: int | None = None, end_ms: int | None = None, limit: int | None = None) -> DataFrame:
        """(ts_ms, o, h, l, c, v, oi) of one series in order of time, both ends included; with a limit the latest so many."""
        out = self.bars().where((F.col("interval") == interval) & (F.col("symbol") == symbol) & (F.col("segment") == segment))
        for bound, holds in ((start_ms, lambda a, b: a >= b), (end_ms, lambda a, b: a <= b)):
            if bound is not None:
                out = out.where(holds(F.col("ts_ms"), F.lit(bound)) & holds(F.col("month"), _month(F.lit(bound))))
        out = out.select("ts_ms", "o", "h", "l", "c", "v", "oi")
        return (out.orderBy(F.desc("ts_ms")).limit(limit) if limit else out).orderBy("ts_ms")

    def latest(self, n: int) -> DataFrame:
        """The last n bars of every series. The month of a series' nth last bar is found from counts, and only from there on are bars ranked."""
        bars = self.bars()
        months = bars.groupBy(*SERIES, "month").agg(F.count("*").alias("k"))
        later = F.coalesce(F.sum("k").over(_series_window("month", True)), F.lit(0))
        needed = months.withColumn("later", later).where(F.col("later") < n).select(*SERIES, "month")
        ranked = bars.join(needed, [*SERIES, "month"]).withColumn("k", F.row_number().over(_series_window("ts_ms", False)))
        return ranked.where(F.col("k") <= n).drop("k")

    def inventory(self) -> DataFrame:
        """(symbol, segment, interval, n, first_day, last_day): days at +05:30."""
        return self.bars().groupBy(*SERIES).agg(F.count("*").alias("n"), _date(F.min("ts_ms")).alias("first_day"), _date(F.max("ts_ms")).alias("last_day"))

    def coverage(self, symbol: str, segment: str, interval: str) -> DataFrame:
        """One row, also of a series that is not there: n, first_ms and last_ms."""
        own = self.read(symbol, segment, interval).agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
        return own.select(F.lit(symbol).alias("symbol"), F.lit(segment).alias("segment"), F.lit(interval).alias("interval"), "n", "first_ms", "last_ms")


def _series_window(order: str, before: bool):
    w = Window.partitionBy(*SERIES).orderBy(F.desc(order))
    return w.rowsBetween(Window.unboundedPreceding, -1) if before else w


def _any_of(touched: list) -> Column:
    """Filter on partition columns that the scan prunes by: the months of each (interval, symbol)."""
    months: dict[tuple, list] = {}
    for r in touched:
        months.setdefault((r["interval"], r["symbol"]), []).append(r["month"])
    groups: dict[tuple, list] = {}
    for (interval, symbol), own in months.items():  # symbols of the same months share one term
        groups.setdefault((interval, *sorted(own)), []).append(symbol)
    terms = [(F.col("interval") == g[0]) & F.col("symbol").isin(names) & F.col("month").isin(list(g[1:])) for g, names in groups.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out
