"""Line dedup: lines spread over many sites are boilerplate and go.

Each line's hash gets a HyperLogLog sketch of the sites that hold it; sketches merge by
aggregation. Texts that hold a line of enough sites are put into classes of exact and near copies
by their whole SimHash, and the line gets a sketch of the classes too. Lines whose estimates lie
near the threshold get exact distinct counts. Boilerplate is spread over at least MIN_SITES sites
and at least as many classes: copies count once, so a line that only travels with a copied document
is near-duplicate detection's work and stays, while a block repeated in differing documents goes.

Null text stays null, empty text and an empty table stay empty. Blank lines are never boilerplate. A
null site counts as one site. Repeated lines in one document and repeated rows add nothing to sites or
classes. A line of exactly min_sites sites and classes is boilerplate. Removal keeps the order of what
stays; a document of boilerplate alone becomes empty. Rows are told apart by a 128-bit digest of doc_id
and text, lines and sites by 64-bit hashes. Texts are read whole. Other columns pass through; a column
named n_removed is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm.common import boxed, let, read, row_key, small, table
from candlemill.llm.simhash import near_duplicates

#: Least distinct sites, and least distinct classes of copies.
MIN_SITES = 8
#: Relative distance from the threshold within which counts are made exact; HLL errs by 1.04/sqrt(2^LG).
NEAR, LG = 0.15, 10


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(line, site, doc) hashes of every line with a word."""
    hashes = lambda ls: F.transform(ls, lambda x: F.when(F.trim(x) != "", F.xxhash64(x)))
    of = docs.where("text is not null").select(
        F.xxhash64(site).alias("site"), F.xxhash64("text").alias("doc"), F.explode(let(F.split("text", "\n", -1), hashes)).alias("line")
    )
    return of.where("line is not null").select("line", "site", "doc")


def _with_class(seen: DataFrame, docs: DataFrame) -> DataFrame:
    """seen with class, which near copies among the texts whose hash is in seen(doc) share."""
    holders = table(seen.select("doc").distinct(), "holders")
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("doc"), "text").join(small(holders, 1_000_000), "doc", "left_semi")
    found = near_duplicates(texts.withColumnRenamed("doc", "doc_id"))
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias("doc"), F.col("component_id").alias("class")).distinct()
    return seen.join(small(table(copies, "line-copies"), 1_000_000), "doc", "left").withColumn("class", F.coalesce("class", "doc"))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(line, sites, classes, exact) of boilerplate line hashes."""
    lines = _lines(docs, site)
    # a line seen fewer times than min_sites has no chance; plain counts come first, sketches for the rest
    often = table(lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line"), "often")
    est = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LG))).alias(c)
    least = min_sites * (1 - NEAR) - 1
    wide = lines.join(small(often, 1_000_000), "line").groupBy("line").agg(est("site")).where(F.col("site") >= least)
    seen = table(lines.join(small(table(wide.select("line"), "wide"), 1_000_000), "line"), "wide-lines")
    seen = table(_with_class(seen, docs), "line-classes")
    about = seen.groupBy("line").agg(est("site"), est("class")).where((F.col("site") >= least) & (F.col("class") >= least))
    near = lambda c: F.abs(F.col(c) - min_sites) <= F.ceil(F.lit(NEAR * min_sites))
    about = table(about.withColumn("near", near("site") | near("class")), "spread")
    unsure = about.where("near").select("line")
    one = F.count_distinct
    exact = seen.join(small(table(unsure, "unsure"), 1_000_000), "line").groupBy("line").agg(one("site").alias("sites"), one("class").alias("classes"), F.lit(True).alias("exact"))
    sure = about.where("not near").select("line", F.col("site").alias("sites"), F.col("class").alias("classes"), F.lit(False).alias("exact"))
    return sure.unionByName(exact).where((F.col("sites") >= min_sites) & (F.col("classes") >= min_sites))


def remove_lines(docs: DataFrame, bad: DataFrame, removed: str = "n_removed") -> DataFrame:
    """docs with text less the lines whose hash is in bad(line), and their number in a column named by removed."""
    hits = docs.where("text is not null").select(row_key().alias("key"), F.explode(F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(x))).alias("line"))
    hits = hits.join(small(bad.select("line"), 1_000_000), "line").groupBy("key").agg(F.collect_set("line").alias("bad"))
    hits = small(table(hits, "line-hits"), 200_000)

    def cut(ls):
        kept = F.filter(ls, lambda x: ~F.array_contains(F.col("bad"), F.xxhash64(x)))
        return F.struct(F.array_join(kept, "\n").alias("text"), (F.size(ls) - F.size(kept)).cast("long").alias("n"))

    both = boxed(docs, row_key().alias("key"), without=(removed,)).join(hits, "key", "left")
    cut_ = F.when(F.col("bad").isNotNull(), let(F.split("row.text", "\n", -1), cut))
    both = both.select("row", cut_.alias("cut"))
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(F.col("cut.text"))
    columns = [(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != removed]
    return both.select(*columns, F.coalesce("cut.n", F.lit(0).cast("long")).alias(removed))


def dedup_lines(docs: DataFrame, site: str = "source", removed: str = "n_removed", **limits) -> DataFrame:
    """docs with boilerplate lines removed and n_chars, where there is one, counted anew."""
    bad = table(boilerplate(docs, site, **limits), "boilerplate")
    out = remove_lines(docs, bad, removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that stays as its SHA-256 and length, and how many lines went."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"))
    return out.select("doc_id", "n_removed", F.char_length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
