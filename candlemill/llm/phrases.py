"""Phrase collocations by prefix-free parsing.

Texts are lower-cased in A-Z and cut into pieces at punctuation and line ends, pieces into words. A piece
is parsed into chunks: a window of OVERLAP words whose hash PERIOD divides ends one chunk and begins
the next, so chunks overlap by OVERLAP words, where they are cut hangs on their words alone, and text
that repeats gives the same chunks anywhere. The dictionary of distinct chunks with their frequencies
is all that is read from there on. A phrase of up to MOST words that begins before a chunk's last
OVERLAP words lies wholly in it and is counted there, one that begins in them in the next chunk; a
piece's last chunk counts all. Each count is weighed by the chunk's frequency.

Frequent phrases are found by size: hashes of words and word pairs are counted first, then those
of longer phrases whose pairs are all frequent, and last, as text, the phrases whose hashes passed. What
has passed is kept in a bit set of fixed width, which may let more through but never less, and the last
counts are of the words themselves, so counts are exact at any width and for any collision.

Null text is empty; empty and wordless texts and an empty table give nothing; a null lang is `und`.
Repeated rows count each time. Texts are read whole; a piece longer than any is many chunks. Ties are
ranked by phrase. Columns other than text and lang play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from candlemill.llm.bitset import bit_set, has
from candlemill.llm.common import UPPER, read, small, table
from candlemill.llm.wordhash import mix, runs_of, slices, word_hashes

MOST, LEAST, TOP = 5, 100, 2000
#: A candidate goes if a longer one around it has at least this percentage of its frequency.
INSIDE_PERCENT = 100
OVERLAP, PERIOD = MOST - 1, 64
#: Distinct chunks a parser holds, and words and phrases that a counter holds, before they are passed on.
HELD_CHUNKS, HELD_GRAMS = 1 << 17, 1 << 21
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_BLANKS = re.compile(rb"[ \t]+")


def chunks(texts: list[bytes]) -> Iterator[tuple[int, bool, bytes, int]]:
    """(number of the text, last of its piece, words joined by spaces, phrase starts that it counts) of each chunk of texts."""
    parts = [t.lower().translate(_CUTS) for t in texts]
    data = b"\n".join(parts)
    if b"\t" in data or b"  " in data:
        parts = [_BLANKS.sub(b" ", t) for t in parts]
        data = b"\n".join(parts)
    h, first = word_hashes(data)
    if not len(h):
        return
    x = np.frombuffer(data + b"\n", np.uint8)
    solid = ~np.isin(x, (32, 10))
    end = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    piece = np.searchsorted(np.flatnonzero(x == 10), first)
    opens = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    closes = np.r_[opens[1:], len(h)]
    size = closes - opens
    at = np.arange(len(h)) - np.repeat(opens, size)
    left = np.repeat(size, size) - at
    cut = np.zeros(len(h), bool)
    windows = runs_of(h, OVERLAP) % np.uint64(PERIOD) == 0
    cut[: len(windows)] = windows
    cut &= (at > 0) & (left > OVERLAP)
    begin = np.flatnonzero(cut | (at == 0))
    after = np.r_[begin[1:], len(h)]
    last = ~np.r_[cut, False][after]
    stop = end[after - 1 + np.where(last, 0, OVERLAP)]
    text = np.searchsorted(np.cumsum(np.fromiter((len(t) + 1 for t in parts), np.int64, len(parts))), first[begin], side="right")
    for i, no, a, b, n in zip(text.tolist(), last.tolist(), first[begin].tolist(), stop.tolist(), (after - begin).tolist()):
        yield i, no, data[a:b], n


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        rows = [(lang, last, chunk, starts, n) for (lang, last, chunk, starts), n in seen.items()]
        kinds = (pa.string(), pa.bool_(), pa.binary(), pa.int64(), pa.int64())
        cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 5, kinds)]
        return pa.RecordBatch.from_arrays(cols, names=["lang", "last", "chunk", "starts", "n"])

    for b in batches:
        langs, done = b.column(0).to_pylist(), 0
        for part in slices(b.column(1).to_pylist()):
            seen.update((langs[done + i], last, chunk, n) for i, last, chunk, n in chunks(part))
            done += len(part)
            if len(seen) > HELD_CHUNKS:
                yield out()
                seen.clear()
    yield out()


def parsed(docs: DataFrame) -> DataFrame:
    """(lang, last, chunk, starts, n): the distinct chunks of docs(text, lang) and their frequencies."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary"))
    rows = rows.mapInArrow(_parse, "lang string, last boolean, chunk binary, starts long, n long")
    return rows.groupBy("lang", "last", "chunk").agg(F.max("starts").alias("starts"), F.sum("n").alias("n"))


def _places(b: pa.RecordBatch):
    """Text of all chunks of a batch, and for each word: its hash, its chunk, the language's hash, words left in the chunk, whether phrases that begin there count, the chunk's frequency."""
    texts = b.column(2).to_pylist()
    data = b" ".join(texts)
    size = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
    row, first = np.repeat(np.arange(len(texts)), size), np.cumsum(size) - size
    at = np.arange(len(row)) - first[row]
    langs = b.column(0).to_pylist()
    of = {x: xxh3_64_intdigest(x) for x in set(langs)}
    lang = np.fromiter((of[x] for x in langs), np.uint64, len(texts))
    return data, word_hashes(data)[0], row, lang[row], size[row] - at, at < b.column(3).to_numpy()[row], b.column(4).to_numpy()[row]


def _keys(h: np.ndarray, lang: np.ndarray, left: np.ndarray, counted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a counted phrase of k words begins, and the phrases' hashes."""
    at = np.flatnonzero((counted & (left >= k))[: max(0, len(h) - k + 1)])
    return at, mix(runs_of(h, k)[at] ^ lang[at])


def _sums(key: list[np.ndarray], weight: list[np.ndarray]) -> pa.RecordBatch:
    k, at = np.unique(np.concatenate([*key, np.empty(0, np.uint64)]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([*weight, np.empty(0, np.int64)]), minlength=len(k)).astype(np.int64)  # exact below 2^53
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "n"])


def _count(sizes: tuple[int, ...], held_by):
    """Task that counts hashes of phrases of such sizes, those of three words or more only where all their pairs are in the bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, weights, size = held_by(), [], [], 0
        for b in (b for b in batches if b.num_rows):
            _, h, _, lang, left, counted, n = _places(b)
            if held is not None:
                pair = np.zeros(len(h) + MOST, bool)
                at, key = _keys(h, lang, left, np.ones(len(h), bool), 2)
                pair[at] = has(held, key)
            for k in sizes:
                ok = counted
                for d in range(k - 1 if held is not None else 0):
                    ok = ok & pair[d : d + len(h)]
                at, key = _keys(h, lang, left, ok, k)
                keys.append(key)
                weights.append(n[at])
                size += len(key)
            if size > HELD_GRAMS:
                yield _sums(keys, weights)
                keys, weights, size = [], [], 0
        yield _sums(keys, weights)

    return run


def _spell(held_by):
    """Task that counts, as text, the phrases whose hashes are in the bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_by()
        for b in (b for b in batches if b.num_rows):
            data, h, row, lang, left, counted, n = _places(b)
            words, langs, out = data.split(b" "), b.column(0).to_pylist(), []
            for k in range(1, MOST + 1):
                at, key = _keys(h, lang, left, counted, k)
                ok = has(held, key)
                key, one, of = np.unique(key[ok], return_index=True, return_inverse=True)
                total = np.bincount(of, weights=n[at[ok]], minlength=len(key)).astype(np.int64)
                out += [(langs[row[i]], b" ".join(words[i : i + k]), w) for i, w in zip(at[ok][one].tolist(), total.tolist())]
            lang_, phrase, total = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(lang_, pa.string()), pa.array(phrase, pa.binary()), pa.array(total, pa.int64())], names=["lang", "phrase", "f"])

    return run


def frequent(dictionary: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to MOST words that occur at least that often; a written table."""
    sc = dictionary.sparkSession.sparkContext
    count = lambda sizes, held: dictionary.mapInArrow(_count(sizes, held), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
    short = table(count((1, 2), lambda: None), "short-phrases")
    pairs = sc.broadcast(bit_set(short))
    long = table(count(tuple(range(3, MOST + 1)), lambda: pairs.value), "long-phrases")
    passed = sc.broadcast(bit_set(short.union(long)))
    told = dictionary.mapInArrow(_spell(lambda: passed.value), "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return table(told.where(F.col("f") >= least).select("lang", F.col("phrase").cast("string").alias("phrase"), "f"), "frequent")


def _part(words: Column, first, n) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(told: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words or more in told(lang, phrase, f)."""
    words = F.split("phrase", " ", -1)
    cand = told.select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).where(F.size("w") > 1)
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    side = lambda part, f: told.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(small(totals, 100_000), "lang")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", "n", (exact("a") * 1000 * exact("n")).alias("over"), (exact("l") * exact("r")).alias("under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def covered(told: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, phrase) of phrases that a longer frequent one holds nearly as often."""
    w = F.split("phrase", " ", -1)
    longer = told.select("lang", "f", w.alias("w")).where(F.size("w") > 2)
    inner = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    most = inner.select("lang", _part(F.col("w"), F.col("at"), F.col("n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    return told.join(most, ["lang", "phrase"]).where(100 * F.col("around") >= percent * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases in docs(text, lang)."""
    dictionary = table(parsed(docs.select("text", "lang")), "chunks")
    totals = table(dictionary.groupBy("lang").agg(F.sum(F.col("starts") * F.col("n")).alias("n")), "lang-totals")
    told = frequent(dictionary, least)
    kept = scored(told, totals).join(covered(told), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
), told AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT lang, phrase, k, f AS a, c.c AS c, array_to_string(list_slice(w, 1, c.c), ' ') AS x, array_to_string(list_slice(w, c.c + 1, k), ' ') AS y
  FROM told, (SELECT unnest([1, 2, 3, 4]) AS c) c WHERE c.c < k
), scores AS (
  SELECT c.lang, c.phrase, c.a, c.c, p.f AS l, q.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (p.f::HUGEINT * q.f) AS score
  FROM cuts c JOIN told p ON p.lang = c.lang AND p.phrase = c.x JOIN told q ON q.lang = c.lang AND q.phrase = c.y JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scores) WHERE o = 1
), inner_ AS (
  SELECT lang, f, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase
  FROM told, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k
), around AS (
  SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY lang, phrase
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.n, b.score
  FROM best b LEFT JOIN around g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.f IS NULL OR 100 * g.f < {INSIDE_PERCENT} * b.a
) WHERE rank <= {TOP}
"""
