"""Exact order statistics of a group without a task that holds or sorts the group.

A mergeable sketch brackets the wanted ranks of each group. Rows below the bracket are only
counted, rows inside it are counted by value, and the values inside it, a ten-thousandth of the group
and its ties, are summed in order until the rank is reached. A bracket that does not hold its rank, which the
sketch's bound rules out, is an error and no value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch errs by 1/ACCURACY of the rows; the bracket reaches five times as far to either side.
ACCURACY = 100_000


def _edge(p: float):
    return F.percentile_approx("__v", float(min(max(p, 0.0), 1.0)), ACCURACY)


def at_shares(df: DataFrame, by: list[str], value: str, shares: dict[str, float], middle: bool = False) -> DataFrame:
    """by and, for each name in shares, the least value that at least that share of a group's values do not exceed.

    With middle, the mean of that value and the next where the share ends between two rows, so a
    share of one half is the median. Nulls do not count; a group of nulls alone has no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    off = 5.0 / ACCURACY
    spans = [F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p"), _edge(p - off).alias("lo"), _edge(p + off).alias("hi")) for k, p in shares.items()]
    size = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.array(*spans).alias("__spans"))
    # sizes hold one row a group and go to the rows: left to itself, Spark sends the rows where a file is small, though they may be many times it
    met = rows.join(F.broadcast(size), by) if by else rows.crossJoin(F.broadcast(size))
    x = met.select(*by, "__n", "__v", F.explode("__spans").alias("s")).where("__v <= s.hi")
    inside = F.when(F.col("__v") >= F.col("s.lo"), F.col("__v"))
    key = [*by, "__n", F.col("s.k").alias("k"), F.col("s.p").alias("p")]
    counts = x.groupBy(*key, inside.alias("v")).agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*by, "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto)
    rank = F.greatest(F.ceil(F.col("p") * F.col("__n")), F.lit(1))
    at = lambda r: F.min(F.when(F.col("v").isNotNull() & (F.col("upto") >= r), F.col("v")))
    # the next row's value lies outside the bracket only where the share ends at the group's last row
    after = F.when(F.col("p") * F.col("__n") == rank, F.least(rank + 1, F.col("__n"))).otherwise(rank) if middle else rank
    # rows below the bracket must fall short of the rank, those up to its end must reach the next row's
    held = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("upto")) - rank) < 0, F.lit(True)) & (F.max(F.col("upto") - after) >= 0)
    value = (at(rank) + at(after)) / 2 if middle else at(rank)
    found = counts.groupBy(*by, "k").agg(F.when(held, value).otherwise(F.raise_error("a sketch's bracket missed its rank")).alias("value"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("k") == k, F.col("value"))).alias(k) for k in shares))
