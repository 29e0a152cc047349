"""Exponential averages as an affine scan over chunks, without a task that holds a whole series.

An exponential average is y <- (1-k) y + k x, so a chunk of values is one affine map. Each chunk's
map is folded on its own, the value that enters a chunk is composed from the maps before it, and
the chunk is then replayed from that value. A chunk has at least eight periods, so the maps of
more than BACK chunks before scale what entered them by less than a double can tell. What is infinite or no
number stays so at any distance, so it is carried on by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BACK = 6


def ema(df: DataFrame, value: str, period: int, out: str, by: str = "symbol", order: str = "ts_ms") -> DataFrame:
    """df with out, the average of value seeded by the first value; one row a (by, order)."""
    k = 2.0 / (period + 1)
    size = max(256, 8 * period)
    w = Window.partitionBy(by).orderBy(order)
    rows = df.withColumn("__n", F.row_number().over(w)).withColumn("__chunk", F.floor((F.col("__n") - 1) / size))
    point = F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("x"))
    chunks = rows.groupBy(by, "__chunk").agg(F.array_sort(F.collect_list(point)).alias("points"))
    first = F.element_at("points", 1)["x"]
    start = F.when(F.col("__chunk") == 0, first).otherwise(0.0)
    own = F.aggregate("points", start, lambda y, p: y * (1 - k) + p["x"] * k)
    chunks = chunks.withColumn("map", F.struct(F.when(F.col("__chunk") == 0, 0.0).otherwise(F.pow(F.lit(1 - k), F.size("points"))).alias("a"), own.alias("b")))
    earlier = Window.partitionBy(by).orderBy("__chunk")
    maps = F.collect_list("map").over(earlier.rowsBetween(-BACK, -1))
    odd = F.when(F.isnan(F.col("map.b") - F.col("map.b")), F.col("map.b")).otherwise(0.0)  # infinite or no number: no distance makes it small
    kept = F.sum(odd).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("enter", F.when(F.col("__chunk") == 0, first).otherwise(F.aggregate(maps, F.lit(0.0), lambda y, m: y * m["a"] + m["b"]) + kept))
    seed = F.slice(F.array(F.struct(F.lit(None).cast(df.schema[order].dataType).alias("at"), F.col("enter").alias("y"))), 1, 1)
    run = F.aggregate("points", seed, lambda ys, p: F.concat(ys, F.array(F.struct(p["at"].alias("at"), (F.element_at(ys, -1)["y"] * (1 - k) + p["x"] * k).alias("y")))))
    values = chunks.select(F.col(by).alias("__by"), F.explode(F.slice(run, 2, F.size("points"))).alias("v")).select("__by", F.col("v.at").alias("__at"), F.col("v.y").alias(out))
    own = F.col(by).eqNullSafe(F.col("__by")) & (F.col(order) == F.col("__at"))  # rows without a by are a series too
    return df.join(values, own).drop("__by", "__at")


def trailing(df: DataFrame, value: str, period: int, bars: int, out: str, by: str = "symbol", order: str = "ts_ms") -> DataFrame:
    """df with out, the average over the last bars values alone, seeded by the first of them.

    Both averages follow one rule from the window's first value on, so their difference there, the
    continuous average less the seed, has shrunk by 1 - k a bar since: one scan and one lag give what
    a fold of every window would.
    """
    k, w = 2.0 / (period + 1), Window.partitionBy(by).orderBy(order)
    rows = ema(_finite(df, value, bars, w), "__x", period, "__y", by, order)
    ago = F.lag(F.col("__y") - F.col("__x"), bars - 1).over(w)
    own = F.col("__y") - F.coalesce(ago * (1 - k) ** (bars - 1), F.lit(0.0))
    return rows.withColumn(out, F.coalesce("__odd", own)).drop("__x", "__y", "__odd")


def _finite(df: DataFrame, value: str, bars: int, w) -> DataFrame:
    """df with __x, value with 0 for what is infinite or no number, and __odd, what such values make of a fold of the last bars values, else null.

    Windows without them are then folded as if they had never been.
    """
    x, past, nan, inf = F.col(value).cast("double"), w.rowsBetween(Window.unboundedPreceding, 0), float("nan"), float("inf")
    rows = df.withColumn("__n", F.row_number().over(w))
    seen = lambda v: F.coalesce(F.col("__n") - F.last(F.when(x == v, F.col("__n")), True).over(past) < bars, F.lit(False))  # noqa: E731 - NaN equals NaN in Spark
    rows = rows.withColumns({"__nan": seen(nan), "__up": seen(inf), "__down": seen(-inf)})
    odd = F.when(F.col("__nan") | (F.col("__up") & F.col("__down")), nan).when(F.col("__up"), inf).when(F.col("__down"), -inf)
    return rows.withColumns({"__x": F.when(F.isnan(x - x), 0.0).otherwise(x), "__odd": odd}).drop("__n", "__nan", "__up", "__down")


def trailing_line(df: DataFrame, value: str, fast: int, slow: int, signal: int, bars: int, by: str = "symbol", order: str = "ts_ms") -> DataFrame:
    """df with line and signal of the last bars values alone: the difference of two trailing averages and that difference's average within the window.

    Within a window the line is the continuous one less two terms that shrink geometrically from the
    window's first bar; the average of each term has a closed form, and the continuous line's is put right
    as in trailing(), so again nothing is folded a window.
    """
    rates, m = [2.0 / (p + 1) for p in (fast, slow, signal)], bars - 1
    w = Window.partitionBy(by).orderBy(order)
    rows = ema(ema(_finite(df, value, bars, w), "__x", fast, "__f", by, order), "__x", slow, "__s", by, order).withColumn("__l", F.col("__f") - F.col("__s"))
    rows = ema(rows, "__l", signal, "__g", by, order)
    ago = lambda c: F.coalesce(F.lag(c, m).over(w), F.lit(0.0))  # noqa: E731 - windows not yet full are the series so far
    f0, s0, g0 = ago(F.col("__f") - F.col("__x")), ago(F.col("__s") - F.col("__x")), ago(F.col("__g") - F.col("__l"))
    weights = []
    for rate in rates[:2]:  # average, after m bars, of a term that begins at 1 and shrinks by its own rate
        y, term = 1.0, 1.0
        for _ in range(m):
            term *= 1 - rate
            y += (term - y) * rates[2]
        weights.append((term, y))
    (a, a_mean), (b, b_mean) = weights
    line = F.col("__l") - f0 * a + s0 * b
    mean = F.col("__g") - g0 * (1 - rates[2]) ** m - f0 * a_mean + s0 * b_mean
    said = lambda y: F.when(F.col("__odd").isNotNull(), float("nan")).otherwise(y)  # noqa: E731 - the line is infinity less infinity
    return rows.withColumns({"line": said(line), "signal": said(mean)}).drop("__x", "__odd", "__f", "__s", "__l", "__g")
