"""N-gram Jaccard join: documents whose shingle sets are alike, found by parity sketches.

A document's set holds its distinct 4-word shingles, words lower-cased in A-Z; fewer words are one
shingle. A parity sketch flips one bit for each token, so two sketches differ in at most as many bits
as the sets' symmetric difference. Sets of 100 * intersection >= PERCENT * union differ in at most
(100 - PERCENT) / (100 + PERCENT) of their sizes' sum. Sizes are cut into bands, each with a sketch of
its own width; a set takes part in the band of its size and in the next one if it may link there.
With D bits at most to differ, the sketch is cut into D + 1 + SPARE segments, of which any two sets
that link share SPARE + 1. Segments are hashed to keys; in one order for all, most frequent last, each
set drops its last SPARE keys and still shares one with each set it links to (the first of those they
share). What is common to many, as an empty segment or one that holds only a frequent passage, is what
goes; no key and no pair is capped.

Sets of a kept key meet in two steps. Each is first held against the least set of its keys, which
joins families of copies. Keys whose sets then lie in more than one component are compared in blocks
of at most BLOCK sets, by a folded sketch of FOLD bits, between components only; a block's own memory
is bounded however large the key. A pair of several common keys is named at the least one. Every pair
found is verified on the whole sets.

Equal sets are one node, so copies never multiply. Null, empty and wordless texts have an empty set
and link with nothing, copies of them included. A null doc_id takes part but is never a component's id.
Rows of one doc_id are told apart by their text. Repeated rows get equal results. Texts are read whole.
An empty table gives no rows. Columns other than doc_id and text play no part, whatever their names.
Shingles are told apart by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from candlemill.llm.bitset import bit_set, has
from candlemill.llm.common import UPPER, read, row_key, small, table
from candlemill.llm.components import connected_components
from candlemill.llm.wordhash import mix, shingles_by_text, slices

SHINGLE, PERCENT = 4, 85
#: Growth of the size bands, whose first holds the smallest sets that may link to others.
GROWTH = 1.4
#: Bits of a segment (as a power of two) and of the folded sketch.
SEGMENT_BITS, FOLD = 16, 1024
#: Most sets that are compared at once, and most of a centre's pairs that one task verifies.
BLOCK, PAIRS = 1024, 2000
#: A set's least keys, by which two sets of several common keys are named once.
LISTED = 32


def most_apart(total: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes sum to total."""
    return (100 - PERCENT) * total // (100 + PERCENT)


def _bounds() -> list[int]:
    n = 1
    while not most_apart(2 * n - 1):  # smaller sets link to equal ones only
        n += 1
    out = [n]
    while out[-1] < 1 << 32:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


BOUNDS = _bounds()


def spare(band: int) -> int:
    return 2 + most_apart(2 * (BOUNDS[band + 1] - 1)) // 8


def segments(band: int) -> int:
    return most_apart(2 * (BOUNDS[band + 1] - 1)) + 1 + spare(band)


def segment_keys(h: np.ndarray, size: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments of sorted sets' parity sketches, one set after the other, and how many each has; the band is in a key's low six bits."""
    m = np.array([segments(j) for j in range(len(BOUNDS) - 1)])[band]
    seg = ((h >> np.uint64(32)) * np.repeat(m, size).astype(np.uint64)) >> np.uint64(32)
    bit = (seg << np.uint64(SEGMENT_BITS)) | (h & np.uint64((1 << SEGMENT_BITS) - 1))
    base = np.cumsum(m) - m
    at = np.repeat(base, size) + seg.astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    odd = np.zeros(int(m.sum()), np.uint64)  # XOR of the hashes of a segment's bits: bits met twice cancel, as in the sketch
    if len(at):
        odd[at[first]] = np.bitwise_xor.reduceat(mix(bit + np.uint64(1)), first)
    of = np.repeat(band, m).astype(np.uint64)
    place = (np.arange(len(odd)) - np.repeat(base, m)).astype(np.uint64)
    key = mix(odd + place * np.uint64(0xD1342543DE82EF95) + of)
    return ((key >> np.uint64(14)) << np.uint64(6) | of).view(np.int64), m


def folded(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parity sketches of FOLD bits, a row of bytes a set."""
    at = np.repeat(np.arange(len(size)), size) * FOLD + ((h >> np.uint64(20)) & np.uint64(FOLD - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=len(size) * FOLD) & 1).astype(bool).reshape(-1, FOLD), axis=1)


def digest(h: np.ndarray) -> bytes:
    return hashlib.md5(h.tobytes(), usedforsecurity=False).digest()


def _node(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def _digests(h: np.ndarray, size: np.ndarray) -> list[bytes]:
    ends = np.cumsum(size)
    return [digest(h[e - n : e]) for e, n in zip(ends.tolist(), size.tolist())]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for part in slices(b.column(2).to_pylist()):
            h, size = shingles_by_text(part, SHINGLE)
            marks, fold = _digests(h, size), folded(h, size)
            none = size == 0
            new = [
                pa.array(size), pa.array([d.hex() for d in marks], pa.string(), mask=none), pa.array([_node(d) for d in marks], pa.int64()),
                pa.array([x.tobytes() for x in fold], pa.binary(), mask=none),
            ]
            given = b.slice(at, len(part))
            yield pa.RecordBatch.from_arrays([given.column(0), given.column(1), *new], names=["doc_id", "key", "n", "cls", "node", "fold"])
            at += len(part)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, cls, node, fold) of every row: its set's size, digest, the digest's first 64 bits and folded sketch."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    schema = schema.add("key", "string").add("n", "long").add("cls", "string").add("node", "long").add("fold", "binary")
    return docs.select("doc_id", row_key().alias("key"), F.col("text").cast("binary")).mapInArrow(_describe, schema)


def _emit(held_by):
    """Task that gives (key, node) of every text; held_by() gives the bit set of shared keys or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_by()
        for part in (p for b in batches for p in slices(b.column(0).to_pylist())):
            h, size = shingles_by_text(part, SHINGLE)
            node = np.fromiter(map(_node, _digests(h, size)), np.int64, len(size))
            own = np.searchsorted(BOUNDS, size, side="right") - 1
            following = np.array(BOUNDS)[own + 1]
            for band, takes in ((own, own >= 0), (own + 1, (size > 0) & (100 * size >= PERCENT * following))):
                keys, m = segment_keys(h[np.repeat(takes, size)], size[takes], band[takes])
                of = np.repeat(node[takes], m)
                if held is not None:
                    ok = has(held, keys)
                    keys, of = keys[ok], of[ok]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(of)], names=["key", "node"])

    return run


def shared_rows(docs: DataFrame) -> DataFrame:
    """(key, node, n) of every key that several texts have; n is how many."""
    texts = docs.where("text is not null").select(F.col("text").cast("binary"))
    counted = texts.mapInArrow(_emit(lambda: None), "key long, node long").groupBy("key").agg(F.count("*").alias("n"))
    shared = table(counted.where("n > 1"), "shared-keys")
    held = docs.sparkSession.sparkContext.broadcast(bit_set(shared.select("key")))
    rows = texts.mapInArrow(_emit(lambda: held.value), "key long, node long")
    return table(rows.join(small(shared, 1_000_000), "key").distinct(), "shared-rows")


def _spare(key):
    """Keys that a set drops, by the band in its key."""
    used = range(len(BOUNDS) - 1)
    return F.get(F.array(*(F.lit(spare(j)) for j in used)), key.bitwiseAND(F.lit(63)).cast("int"))


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, v = [], []
        for x, y, p, q in zip(*(b.column(i).to_pylist() for i in range(4))):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= PERCENT * (len(p) + len(q) - both):
                u.append(x)
                v.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], names=["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for b in batches for p in slices(b.column(0).to_pylist())):
        h, size = shingles_by_text(part, SHINGLE)
        marks, ends = _digests(h, size), np.cumsum(size)
        hashes = [h[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist())]
        cols = [pa.array([_node(d) for d in marks], pa.int64()), pa.array([d.hex() for d in marks], pa.string()), pa.array(hashes, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["node", "cls", "hashes"])


def verified(pairs: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) digests of the pairs(u, v) of nodes, u the one that has many, whose whole sets link."""
    pairs = table(pairs, "candidates")
    need = table(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "needed")
    reps = own.where("n > 0").join(small(need, 1_000_000), "node").groupBy("cls").agg(F.min("key").alias("key")).select("key")
    texts = docs.where("text is not null").select(row_key().alias("key"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(small(table(reps, "needed-texts"), 1_000_000), "key", "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "node long, cls string, hashes binary").groupBy("node", "cls").agg(F.first("hashes").alias("hashes"))
    sets = table(sets, "sets")
    # a centre's pairs are dealt over as many parts as they need, with its set in each
    parts = F.ceil(F.col("n") / PAIRS).cast("int")
    many = table(pairs.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS).select("u", parts.alias("parts")), "centres")
    dealt = pairs.join(small(many, 1_000_000), "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    first = sets.join(small(many, 1_000_000).withColumnRenamed("u", "node"), "node", "left")
    first = first.select(F.col("node").alias("u"), F.col("cls").alias("a"), F.col("hashes").alias("p"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    other = sets.select(F.col("node").alias("v"), F.col("cls").alias("b"), F.col("hashes").alias("q"))
    met = dealt.join(other, "v").join(first, ["u", "part"]).select("a", "b", "p", "q")
    return table(met.mapInArrow(_intersect, "u string, v string").distinct(), "links")


def _near(n: np.ndarray, fold: np.ndarray, comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of sets lie in two components and may link by their sizes and folded sketches."""
    a, b = n[i], n[j]
    ok = (comp[i] != comp[j]) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
    at = np.flatnonzero(ok)
    apart = np.bitwise_count(fold[i[at]] ^ fold[j[at]]).sum(axis=1, dtype=np.int64)
    ok[at] = apart <= (100 - PERCENT) * (a[at] + b[at]) // (100 + PERCENT)
    return ok


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs inside runs of equal (key, s, t); a run holds block s and block t of its key."""

    def pairs(cols):
        key, s, t, block, node, comp, n, fold, listed = cols
        run = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])]) - 1
        size, u, v = np.bincount(run), [], []
        few = np.flatnonzero(size[run] <= 64)
        for d in range(1, 64):
            at = few[:-d][run[few[d:]] == run[few[:-d]]] if len(few) > d else few[:0]
            if not len(at):
                break
            u.append(at)
            v.append(at + d)
        first = np.r_[0, np.cumsum(size)]
        for k in np.flatnonzero(size > 64):
            for i in range(first[k], first[k + 1] - 1):
                j = np.arange(i + 1, first[k + 1])
                j = j[_near(n, fold, comp, np.full(len(j), i), j)]
                u.append(np.full(len(j), i))
                v.append(j)
        u, v = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (u, v))
        ok = ((s[u] == t[u]) | (block[u] != block[v])) & _near(n, fold, comp, u, v)
        u, v = u[ok], v[ok]
        held = {i: frozenset(listed[i]) for i in {*u.tolist(), *v.tolist()}}
        # named at the least of the common keys that both list; at each where they list none in common
        once = np.fromiter((min(held[i] & held[j], default=k) == k for i, j, k in zip(u.tolist(), v.tolist(), key[u].tolist())), bool, len(u))
        u, v = u[once], v[once]
        a, b = np.minimum(node[u], node[v]), np.maximum(node[u], node[v])
        a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    def arrays(b):
        ints = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        listed = np.empty(b.num_rows, object)
        for i, x in enumerate(b.column(8).to_pylist()):
            listed[i] = x
        return [*ints, np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64).reshape(-1, FOLD // 64), listed]

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = arrays(b)
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        key, s, t = held[:3]
        last = (key == key[-1]) & (s == s[-1]) & (t == t[-1])
        at = int(np.argmax(last))  # where the last run begins; it may go on in the next batch
        if at:
            yield pairs([x[:at] for x in held])
            held = [x[at:] for x in held]
    if held is not None:
        yield pairs(held)


def _between(kept: DataFrame, own: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes of different components that share a kept key and may link."""
    facts = own.where("n > 0").groupBy("node").agg(F.min("cls").alias("cls"), F.min("n").alias("n"), F.min("fold").alias("fold"))
    facts = facts.join(small(roots, 1_000_000).withColumnRenamed("node", "cls"), "cls", "left")
    comp = table(facts.select("node", F.xxhash64(F.coalesce("root", "cls")).alias("comp"), "n", "fold"), "node-facts")
    of = kept.join(small(comp.select("node", "comp"), 1_000_000), "node")
    mixed = of.groupBy("key").agg(F.count("*").alias("rows"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    mixed = table(mixed.select("key", F.ceil(F.col("rows") / (BLOCK // 2)).cast("int").alias("blocks")), "mixed-keys")
    rows = of.join(small(mixed, 1_000_000), "key").select("key", "node", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "blocks")
    rows = table(rows, "mixed-rows")
    listed = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LISTED).alias("listed"))
    facts = table(comp.join(listed, "node"), "mixed-facts")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.join(small(facts, 100_000), "node").select("key", F.least("block", "with").alias("s"), F.greatest("block", "with").alias("t"), "block", "node", "comp", "n", "fold", "listed")
    met = rows.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t")
    return met.mapInArrow(_compare, "u long, v long").distinct()


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """described(docs), and (node, root) of the digests that link to another one."""
    own = table(described(docs), "sets-described")
    rows = shared_rows(docs)
    last = Window.partitionBy("node", F.col("key").bitwiseAND(F.lit(63))).orderBy(F.desc("n"), "key")
    kept = table(rows.withColumn("at", F.row_number().over(last)).where(F.col("at") > _spare(F.col("key"))).select("key", "node"), "kept-keys")
    centre = kept.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("key", "u")
    stars = kept.join(small(table(centre, "centres-of-keys"), 1_000_000), "key").where("u <> node").select("u", F.col("node").alias("v")).distinct()
    links = verified(stars, own, docs)
    roots = connected_components(links)
    more = verified(_between(kept, own, roots), own, docs)
    return own, connected_components(links.union(more))


def near_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text)."""
    own, roots = linked_sets(docs.select("doc_id", "text"))
    nodes = own.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_doc")).join(small(roots, 1_000_000).withColumnRenamed("node", "cls"), "cls", "left")
    nodes = table(nodes.withColumn("root", F.coalesce("root", "cls")), "set-roots")
    least = nodes.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of = table(nodes.join(least, "root").select("cls", "component_id"), "set-classes")
    out = own.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(small(of, 1_000_000), "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_sets(read(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(list_slice(w, i, i + {SHINGLE} - 1), ' '))) END AS g FROM words
), grams AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS g FROM sets
), met AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS both_
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (
  SELECT u, v FROM met WHERE 100 * both_ >= {PERCENT} * (n + m - both_)
), ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT u AS doc_id, u AS seen FROM ways UNION SELECT r.doc_id, w.v FROM reach r JOIN ways w ON w.u = r.seen
), least_ AS (
  SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM sets s LEFT JOIN least_ c ON c.doc_id = s.doc_id
"""
