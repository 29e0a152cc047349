"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Words are runs of ASCII digits, letters and non-ASCII characters, lower-cased in A-Z. Of every
window of six 5-word hashes the least is a fingerprint, so any ten consecutive words shared by a
document and an item share one. Runs of document windows whose fingerprint an item has are
extended: their ten-word windows are compared, as text, with the items' windows. Items of fewer
than ten words are one window of their own length; documents are hashed at those lengths too.

Null, empty or wordless texts have no words and no hits; items without words or without item_id match
nothing, and empty tables of either give no hits or no rows. Several rows of an item_id are one item.
Equal documents get equal results; rows are told apart by a 128-bit digest of doc_id and text. Texts
are read whole, however long. Other columns pass through; those named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm.common import boxed, let, lower_ascii, read, row_key, small, table

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _steps(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(hashes: Column, n: int) -> Column:
    """Hash of each run of n word hashes."""
    return F.transform(_steps(F.size(hashes) - (n - 1)), lambda i: F.xxhash64(*(F.get(hashes, i + d) for d in range(n))))


def minima(h: Column) -> Column:
    """Least of each SPAN consecutive hashes."""
    return F.transform(_steps(F.size(h) - (SPAN - 1)), lambda i: F.least(*(F.get(h, i + d) for d in range(SPAN))))


def runs(m: Column) -> Column:
    """(first, last, fp) of each run of windows with one fingerprint."""
    starts = F.filter(_steps(F.size(m)), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
    return let(
        starts,
        lambda s: F.transform(s, lambda j, k: F.struct(j.alias("first"), (F.coalesce(F.get(s, k + 1), F.size(m)) - 1).alias("last"), F.get(m, j).alias("fp"))),
    )


def _word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _winnowed(text: Column) -> Column:
    return let(_word_hashes(text), lambda w: let(grams(w, GRAM), lambda h: let(minima(h), runs)))


def _windows(words: Column, size) -> Column:
    return F.transform(_steps(F.size(words) - (size - 1)), lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def _of_size(hashes: Column, n: int) -> Column:
    return let(hashes, lambda w: grams(w, n))


def _every(text: Column, n: int) -> Column:
    """(first, last, fp, size) of each n-word window."""
    of = lambda h, i: F.struct(i.alias("first"), i.alias("last"), h.alias("fp"), F.lit(n).alias("size"))
    return let(_word_hashes(text), lambda w: F.transform(grams(w, n), of))


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, size, item_id) of each distinct window of each item, and (window, size, fp) with its fingerprint.

    A window shorter than WINDOW has the hash of its words as fingerprint.
    """
    words = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    words = words.withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    of = table(words.select(F.explode(_windows(F.col("w"), F.col("size"))).alias("window"), "size", "item_id").distinct(), "item-windows")
    hashes = F.transform(F.split("window", " "), lambda w: F.xxhash64(w))
    fp = F.when(F.col("size") == WINDOW, let(hashes, lambda w: F.array_min(grams(w, GRAM))))
    for n in range(1, WINDOW):
        fp = F.when(F.col("size") == n, F.get(_of_size(hashes, n), F.lit(0))).otherwise(fp)
    return of, of.select("window", "size").distinct().withColumn("fp", fp)


def matched_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, at, size, window) of each occurrence in docs(key, text) of a window of windows(window, size, fp)."""
    prints = table(windows, "prints")
    short = sorted(r[0] for r in prints.where(F.col("size") < WINDOW).select("size").distinct().collect())
    candidates = [F.transform(_winnowed(F.col("text")), lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), r["fp"].alias("fp"), F.lit(WINDOW).alias("size")))]
    for n in short:  # at most nine lengths
        candidates.append(_every(F.col("text"), n))
    met = None
    wanted = small(prints.select("fp", "size").distinct(), 1_000_000)
    for c in candidates:
        part = docs.select("key", F.explode(c).alias("r")).select("key", "r.*").join(wanted, ["fp", "size"])
        met = part if met is None else met.union(part)
    hits = met.groupBy("key").agg(F.collect_set(F.struct("first", "last", "size")).alias("runs"))
    hits = small(table(hits, "runs"), 200_000)
    near = docs.join(hits, "key").select("key", "runs", words_of(F.col("text")).alias("w"))

    def spell(ws, rs):
        each = F.transform(rs, lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda j: F.struct(j.alias("at"), r["size"].alias("size"), F.array_join(F.slice(ws, j + 1, r["size"]), " ").alias("window"))))
        return F.flatten(each)

    found = near.select("key", F.explode(let(F.col("w"), lambda ws: spell(ws, F.col("runs")))).alias("x")).select("key", "x.*").distinct()
    return found.join(small(prints.select("window", "size").distinct(), 500_000), ["window", "size"])


def contamination(docs: DataFrame, items: DataFrame, prefix: str = "") -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated, each name after prefix."""
    of, windows = item_windows(items)
    found = table(matched_windows(docs.where("text is not null").select(row_key().alias("key"), "text"), windows), "matches")
    spans = F.collect_list(F.struct("at", "size"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))))
    hit = found.distinct().groupBy("key").agg(covered.cast("long").alias("hit"))
    ids = found.select("key", "window", "size").distinct().join(small(of, 500_000), ["window", "size"])
    ids = ids.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    both = small(table(hit.join(ids, "key"), "contaminated"), 500_000)
    names = [prefix + n for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    n = F.coalesce(F.regexp_count("text", F.lit(ANY_CASE)), F.lit(0)).cast("long")
    out = boxed(docs, row_key().alias("key"), n.alias("n"), without=tuple(names)).join(both, "key", "left")
    none = F.lit(0).cast("long")
    values = [
        F.col("n"), F.coalesce("hit", none), F.coalesce(F.size("ids").cast("long"), none),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256), F.col("hit").isNotNull(),
    ]
    return out.select("row.*", *(v.alias(c) for v, c in zip(values, names)))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of an item."""
    _, windows = item_windows(items)
    found = matched_windows(docs.where("text is not null").select(row_key().alias("key"), "text"), windows)
    bad = small(table(found.select("key").distinct(), "contaminated"), 1_000_000)
    return boxed(docs, row_key().alias("key")).join(bad, "key", "left_anti").select("row.*")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, read(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")


#: Exact windows over every document, without winnowing.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
