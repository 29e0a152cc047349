"""Volatility regimes, learned-filter measures, and fund-versus-index premiums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.quantile import at_shares

# Lower bounds of the volatility bands.
BANDS = (0.0, 12.0, 14.0, 18.0, 25.0)


def context(vix: DataFrame) -> DataFrame:
    """(day, level, ratio, rank) known before each day of vix(day, close).

    level is the preceding archived close, ratio that to the mean of the prior 20 (of as many as
    there are), rank the share of the prior 252 closes strictly below it. The daily series of one
    index is small by nature, so its one window partition is.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("day")
    level = F.lag("close").over(w)
    prior = F.collect_list("close").over(w.rowsBetween(-252, -1))
    v = vix.withColumns({"level": level, "mean20": F.avg("close").over(w.rowsBetween(-20, -1)), "prior": prior})
    below = F.size(F.filter("prior", lambda x: x < F.col("level"))) / F.size("prior")
    return v.where("level is not null").select("day", "level", (F.col("level") / F.col("mean20")).alias("ratio"), below.alias("rank"))


def with_previous_close(trades: DataFrame, vix: DataFrame) -> DataFrame:
    """trades with vix, the archived close before the trade's own day; null where that day is not archived."""
    before = vix.select("day", F.lag("close").over(Window.partitionBy(F.lit(1)).orderBy("day")).alias("vix"))
    return trades.join(F.broadcast(before), "day", "left")  # a row a day; without the hint all trades may be shuffled to meet it


def band(value):
    out = F.lit(None).cast("int")
    for k, low in enumerate(BANDS):
        out = F.when(value >= low, k).otherwise(out)
    return out


def by_band(trades: DataFrame) -> DataFrame:
    """(band, trades, share_pct, win_pct, mean_pts) of trades(vix, pts); empty bands stay with zero trades."""
    t = trades.where("vix is not null").groupBy(band(F.col("vix")).alias("band")).agg(F.count("*").alias("trades"), F.avg((F.col("pts") > 0).cast("double")).alias("win"), F.avg("pts").alias("mean"))
    every = trades.sparkSession.range(len(BANDS)).select(F.col("id").cast("int").alias("band"))
    total = t.agg(F.sum("trades").alias("total"))
    t = every.join(F.broadcast(t), "band", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("trades", F.lit(0))
    return t.select("band", n.alias("trades"), F.round(n / F.col("total") * 100, 6).alias("share_pct"), F.round(F.col("win") * 100, 6).alias("win_pct"), F.round("mean", 6).alias("mean_pts"))


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rank AUC of scored(score, label) with tied ranks averaged; null where a class is missing.

    Counts by distinct score come first, so the ordered window holds scores and not samples.
    """
    return auc_of_counts(scored.groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n")), by)


def auc_of_counts(c: DataFrame, by: list[str]) -> DataFrame:
    """auc() of c(score, pos, n): the samples and positives of each distinct score."""
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("rank", below + (F.col("n") + 1) / 2)
    g = c.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("n").alias("t"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    q = F.col("t") - F.col("p")
    return g.select(*by, F.when((F.col("p") > 0) & (q > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * q)).alias("auc"))


def folds(samples: DataFrame, by: list[str], order: list[str], least: int = 400, blocks: int = 4, least_block: int = 20) -> DataFrame:
    """samples with fold, 0-based, of the expanding walk-forward blocks after the first `least` rows; null before and where blocks are too small.

    Counts by the first column of order tell in which of its values a fold begins and after how many of its rows. Only the rows of
    those values are put in order, all others are told by the value alone and are not shuffled.
    """
    head = order[0]
    counts = _counts_before(samples, by, head)
    block = F.floor((F.col("n") - least) / blocks)
    begins = counts.where(block >= least_block).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    begins = begins.withColumn("skip", (least + F.col("k") * block - F.col("__before")).cast("long")).where("skip >= 0 and skip < __here")
    begins = begins.groupBy(*(f"__{c}" for c in by)).agg(F.sort_array(F.collect_list(F.struct("k", F.col(f"__{head}").alias("head"), "skip"))).alias("__begins"))
    met = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or F.lit(True)
    s = samples.join(F.broadcast(begins), met, "left").drop(*(f"__{c}" for c in by))
    at = [F.get("__begins", F.lit(k)) for k in range(blocks)]
    here = [F.coalesce(x["head"].eqNullSafe(F.col(head)) & x.isNotNull(), F.lit(False)) for x in at]
    # structs compare nulls as the first, as orderBy does
    below = [x.isNotNull() & (F.struct(x["head"]) < F.struct(F.col(head))) for x in at]
    known = lambda place: sum((F.when(b | (h & (x["skip"] <= place)), 1).otherwise(0) for x, h, b in zip(at, here, below)), F.lit(0))
    split = sum((F.when(h & (x["skip"] > 0), 1).otherwise(0) for x, h in zip(at, here)), F.lit(0)) > 0
    place = F.row_number().over(Window.partitionBy(*by, head).orderBy(*order)) - 1
    parts = [s.where(~split).withColumn("__k", known(F.lit(0))), s.where(split).withColumn("__place", place).withColumn("__k", known(F.col("__place"))).drop("__place")]
    return parts[0].unionByName(parts[1]).withColumn("fold", F.when(F.col("__k") > 0, (F.col("__k") - 1).cast("int"))).drop("__k", "__begins")


def _counts_before(samples: DataFrame, by: list[str], head: str):
    """(__by, __head, __here, __before, n): the rows of each value of head in a group, those before it, and the group's."""
    counts = samples.groupBy(*by, head).agg(F.count("*").alias("__here"))
    w = Window.partitionBy(*(by or [F.lit(1)]))
    before = F.sum("__here").over(w.orderBy(head).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__here")
    return counts.select(*(F.col(c).alias(f"__{c}") for c in (*by, head)), "__here", before.alias("__before"), F.sum("__here").over(w).alias("n"))


def numbered(samples: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """samples with i, the 0-based place in the group by order, and n, the group's size.

    Rows are counted by the first column of order, the counts summed, and rows placed within one of its
    values only, so no task sorts a group.
    """
    head = order[0]
    counts = _counts_before(samples, by, head).drop("__here")
    met = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, head)]
    within = F.row_number().over(Window.partitionBy(*by, head).orderBy(*order)) - 1
    s = samples.withColumn("__within", within).join(counts, met)
    return s.withColumn("i", F.col("__before") + F.col("__within")).drop("__before", "__within", *(f"__{c}" for c in (*by, head)))


def keep_economics(scored: DataFrame, fractions=(0.5, 0.4, 0.3, 0.2, 0.1)) -> DataFrame:
    """(keep, threshold, trades, win_pct, net) of scored(score, pts) kept at each fraction's threshold."""
    cuts = at_shares(scored, [], "score", {f"k{k}": 1 - f for k, f in enumerate(fractions)})
    long = cuts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("keep"), F.col(f"k{k}").alias("threshold")) for k, f in enumerate(fractions)))).alias("x")).select("x.*")
    kept = scored.crossJoin(F.broadcast(long)).where("score >= threshold")
    return kept.groupBy("keep", "threshold").agg(F.count("*").alias("trades"), F.round(F.avg((F.col("pts") > 0).cast("double")) * 100, 6).alias("win_pct"), F.round(F.avg("pts"), 6).alias("net"))


def tracking(pairs: DataFrame, last: int = 20, least: int = 8, stable_pct: float = 1.0) -> DataFrame:
    """(fund, n, ratio, mad_pct, stable, fair, premium_pct) of pairs(fund, day, fund_close, index_close).

    The ratio is the median over the last aligned closes; a fund is stable if the median relative
    deviation from it is at most stable_pct.
    """
    p = pairs.where("fund_close > 0 and index_close > 0")
    k = F.row_number().over(Window.partitionBy("fund").orderBy(F.desc("day")))
    p = p.withColumn("k", k).where(F.col("k") <= last).withColumn("r", F.col("fund_close") / F.col("index_close"))
    m = p.groupBy("fund").agg(F.count("*").alias("n"), F.median("r").alias("ratio"), F.max_by("fund_close", "day").alias("close"), F.max_by("index_close", "day").alias("index"))
    d = p.join(m, "fund").groupBy("fund").agg((F.median(F.abs(F.col("r") - F.col("ratio")) / F.col("ratio")) * 100).alias("mad_pct"))
    fair = F.col("ratio") * F.col("index")
    return m.where(F.col("n") >= least).join(d, "fund").select("fund", "n", "ratio", "mad_pct", (F.col("mad_pct") <= stable_pct).alias("stable"), fair.alias("fair"), ((F.col("close") / fair - 1) * 100).alias("premium_pct"))
