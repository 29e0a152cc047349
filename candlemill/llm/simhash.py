"""SimHash near-duplicates found through one-wildcard segment variants.

A fingerprint has 64 bits in three segments (21, 21 and 22 bits). Two fingerprints that differ
in at most four bits have a segment that differs in at most one, so they share that segment with
one bit left out. Each distinct fingerprint is indexed under its 64 such variants, variants are
shuffled to meet, and each meeting is checked on all bits. Of the links in a bucket only those
whose least shared variant is the bucket's are its own, and a bucket larger than SMALL passes on
a spanning forest of them instead of every pair; components stay the same.

Null or wordless text has fingerprint zero. Rows of equal fingerprint are one node, so copies
never multiply. A null doc_id takes part but is never a component's id. Texts are read whole, however
long; an empty table gives no rows. Columns other than doc_id and text play no part, whatever their
names; keep_one() passes them on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.llm.common import read, small, table
from candlemill.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SMALL = 32
_BLOCK = 1 << 16


def simhash(data: bytes | None) -> int:
    """Unsigned fingerprint of UTF-8 text: words lower-cased in A-Z, shingles of four, majority of bits."""
    from xxhash import xxh64_intdigest as h

    words = (data or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    if n <= SHINGLE:
        return h(text, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(first), _BLOCK):
        part = first[at : at + _BLOCK]
        hashes = np.fromiter((h(text[a:b], SEED) for a, b in zip(part, last[at : at + _BLOCK])), np.uint64, len(part))
        for cut in range(0, len(part), 255):  # sums of so few bits fit in a byte
            total += np.unpackbits(hashes[cut : cut + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(first), bitorder="little").view(np.uint64)[0])


def _add_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([simhash(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row of docs(doc_id, text)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_add_fingerprint, schema)


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for each bit, the segment it lies in without it; the key names the bit too."""
    out = []
    for first, width in SEGMENTS:
        for bit in range(first, first + width):
            mask = ((1 << width) - 1) & ~(1 << (bit - first))
            out.append(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(mask)) * 64 + F.lit(bit))
    return fps.select(F.explode(F.array(*out)).alias("key"), "fp")


def least_shared(diff: np.ndarray) -> np.ndarray:
    """Least bit whose variant two fingerprints of that XOR share; 64 if none."""
    best = np.full(diff.shape, 64, np.int64)
    for first, width in reversed(SEGMENTS):
        seg = (diff >> np.uint64(first)) & np.uint64((1 << width) - 1)
        n = np.bitwise_count(seg)
        low = np.bitwise_count(seg - np.uint64(1) & ~seg)  # index of the one bit that differs
        best = np.where(n == 0, first, np.where(n == 1, first + low, best))
    return best


def _linked(diff: np.ndarray, bit) -> np.ndarray:
    near = np.bitwise_count(diff) <= DISTANCE
    near[near] = least_shared(diff[near]) == (bit[near] if np.ndim(bit) else bit)
    return near


def _forest(bit: int, fp: np.ndarray) -> tuple[list, list]:
    """Spanning forest of one large bucket's own links; each row is reached once."""
    left, queue, a, b = fp[1:], [fp[0]], [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        hit = _linked(left ^ x, bit)
        found = left[hit]
        a += [x] * len(found)
        b += found.tolist()
        queue += list(found)
        left = left[~hit]
    return a, b


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal keys; a run may go on in the next batch."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(key, fp):
        cut = np.flatnonzero(np.diff(key)) + 1
        first, size = np.r_[0, cut], np.diff(np.r_[0, cut, len(key)])
        a, b = [], []
        run = np.repeat(size, size)
        few = np.flatnonzero((run > 1) & (run <= SMALL))
        k, f = key[few], fp[few]
        for d in range(1, SMALL):
            same = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else []
            if not len(same):
                break
            hit = same[_linked(f[same] ^ f[same + d], k[same] & 63)]
            a.append(f[hit])
            b.append(f[hit + d])
        for i in np.flatnonzero(size > SMALL):
            x, y = _forest(int(key[first[i]] & 63), fp[first[i] : first[i] + size[i]])
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
        u, v = (np.concatenate([*x, np.empty(0, np.uint64)]).view(np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held: list = []
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(k):
            continue
        held.append((k, f))
        if k[0] == k[-1] and (len(held) == 1 or held[0][0][-1] == k[0]) and held[0][0][0] == k[-1]:
            continue
        key, fp = (np.concatenate(x) for x in zip(*held))
        at = int(np.searchsorted(key, key[-1]))
        held = [(key[at:], fp[at:])]
        yield links(key[:at], fp[:at])
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links."""
    own = table(fingerprints(docs), "fingerprints")
    nodes = table(own.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    met = variants(nodes).repartition("key").sortWithinPartitions("key")
    links = met.mapInArrow(_bucket_links, "u long, v long")
    roots = connected_components(links)
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.where("root is not null").groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of = table(grouped.join(least, "root").select("fp", "component_id"), "classes")
    return own.join(small(of, 1_000_000), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those whose component has a smaller doc_id; rows of one doc_id are one document.

    Rows without a doc_id stay.
    """
    drop = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small(table(drop, "copies"), 1_000_000), "doc_id", "left_anti").select(docs.columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
