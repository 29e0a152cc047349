"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.common import table


def _stars(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour, then every smaller one, on the least of its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    hung = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = hung.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return hung.union(root).where("u <> v").distinct()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for each node of links(u long, v long); root is the component's least node.

    Only nodes with a link to another node appear. No links give no rows. Each round is written
    to the shared folder; rounds end when a round changes nothing.
    """
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = table(e, "links")
    state = None
    for _ in range(max_rounds):
        e = table(_stars(e), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    own = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own)
