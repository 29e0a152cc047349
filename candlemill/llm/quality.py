"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed unigrams and bigrams are counted over all documents: the raw corpus
and the trusted target (documents labelled quality 1 and not toxic). A document's score is the
mean over its features of log target/raw. The threshold is what all but LOST of the labelled good
documents that pass the base rules reach, less MARGIN; good but toxic documents are no part of the
target and so stand for documents the model has not seen. A document is kept when it passes the
base rules and its score reaches the threshold. The model is one weight a bucket, a fixed size at
any input.

Null text has no words and fails the base rules. Without trusted documents, or without
documents, every weight is zero and the base rules decide alone. Several labels of a document
count as trusted when its highest quality is 1 and none is toxic. Equal rows get equal results. Texts are
read whole, however long. Other columns pass through whatever their names: the rules' own columns stand
under names that none of them begins with.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.llm.common import SPACE, fresh, read, small, table

BUCKETS = 1 << 16
#: Additive smoothing of both multinomials, in counts a bucket.
SMOOTHING = 1.0
#: Share of labelled good documents below the threshold before MARGIN, and the threshold without labels.
LOST, MARGIN, DEFAULT = 0.005, 0.02, -0.3
#: Bins a unit of score, in which labelled scores are counted; scores lie within the log of the corpus size.
BINS = 1000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Number of each word in order of first use, and the distinct words."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return ids, list(known)


def features(ids: np.ndarray, distinct: list[bytes]) -> np.ndarray:
    """Buckets of unigrams and bigrams, words lower-cased in A-Z."""
    h = np.fromiter((zlib.crc32(w.lower()) for w in distinct), np.uint64, len(distinct))[ids]
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    one = h * np.uint64(0xA24BAED4963EE407)
    return (np.concatenate([one, two]) >> np.uint64(48)).astype(np.int64)


def repeat_words(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a 3-word window which the text holds at least twice."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if kinds < 1 << 21:
        code = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
        _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    else:
        rows = np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1)
        _, at, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    hit = count[at.reshape(-1)] > 1
    cover = np.zeros(len(ids), bool)
    for d in range(3):
        cover[d : d + n] |= hit
    return int(cover.sum())


def base_counts(data: bytes, words: list[bytes], ids: np.ndarray, kinds: int) -> tuple[int, ...]:
    points = len(data.translate(None, _CONTINUATION))
    blank = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    return len(words), points - blank, symbols, len(lines) - len(set(lines)), repeat_words(ids, kinds)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for data, trusted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = (data or b"").split()
            if words:
                n = np.bincount(features(*word_ids(words)), minlength=BUCKETS)
                raw += n
                if trusted:
                    target += n
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weight of each bucket, from counts over all rows of docs; BUCKETS rows reach the driver."""
    sure = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    sure = sure.where("q = 1 and coalesce(t, 0) <> 1").select("doc_id", F.lit(True).alias("trusted"))
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(small(sure, 1_000_000), "doc_id", "left")
    parts = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(_count_features, "bucket long, raw long, target long")
    rows = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]] = rows["raw"]
    target[rows["bucket"]] = rows["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = (x + SMOOTHING for x in (target, raw))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def score(docs: DataFrame, weights: np.ndarray, prefix: str = "") -> DataFrame:
    """docs with COUNTS, base_failed and score, each name after prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            rows = []
            for data in b.column(b.num_columns - 1).to_pylist():
                data = data or b""
                words = data.split()
                ids, distinct = word_ids(words)
                base = base_counts(data, words, ids, len(distinct))
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                mean = float(w[features(ids, distinct)].mean()) if words else 0.0
                rows.append((*base, failed, mean))
            new = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()]
            arrays = [*b.columns[:-1], *(pa.array(x, k) for x, k in zip(new, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    given = docs.select("*", F.col("text").cast("binary").alias(fresh(docs.columns, "data")))
    schema = T.StructType([*docs.schema])
    for c in COUNTS:
        schema = schema.add(prefix + c, "long")
    schema = schema.add(prefix + "base_failed", "boolean").add(prefix + "score", "double")
    names = schema.names
    return given.mapInArrow(judge, schema)


def threshold(scored: DataFrame, labels: DataFrame, prefix: str = "") -> float:
    """Score that labelled good documents reach, from counts by bin."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    bins = scored.where(~F.col(prefix + "base_failed")).select("doc_id", F.floor(F.col(prefix + "score") * BINS).alias("bin"))
    rows = sorted(map(tuple, bins.join(small(good, 1_000_000), "doc_id").groupBy("bin").agg(F.count("*")).collect()))
    below, total = 0, sum(n for _, n in rows)
    for at, n in rows:
        below += n
        if below > LOST * total:
            return at / BINS - MARGIN
    return DEFAULT


def verdict(docs: DataFrame, labels: DataFrame, prefix: str = "", without: tuple[str, ...] = ()) -> DataFrame:
    """docs, less some columns, with COUNTS, base_failed, score and kept; a written table."""
    scored = table(score(docs, fit(docs, labels), prefix).drop(*without), "scores")
    passed = F.col(prefix + "score") >= threshold(scored, labels, prefix)
    return scored.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & passed)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that the rules keep, with their columns as they were."""
    mark = fresh(docs.columns, "q_")
    return verdict(docs, labels, mark).where(mark + "kept").select(docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), without=("text",))
