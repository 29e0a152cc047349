"""Substring dedup: fuzzy passages that documents share, by collinear chaining of seeds.

Each document's 5-word hashes are winnowed to seeds (any GRAM + WINDOW - 1 equal words hold one). At each
seed a run begins too: the RUN words from there on, so that any MIN_WORDS equal words hold a whole run.
Seeds and runs meet in a shuffle; each occurrence is matched with the first document that has the
seed or run, its representative, and a seed also with the one before it in order of doc_id, so matches
grow with the seeds and not with the square of the documents that share one, while neighbours in a
family of edited copies are still compared. Who first has a run shares all of it: each document that
has MIN_WORDS equal words with an earlier one is linked to the representative of each of their runs,
so rows (doc_id, other_id) are the membership of a run's class and pairs between representatives, and
no exact link is lost between components. Seeds that HOT_SHARE of a sample of documents hold are dealt
over salts of doc_id; their salts' representatives are matched once more among themselves.

The matches of a pair of documents are chained: the best chain of matches in order on both sides pays
for gaps, found through a Fenwick tree over places in the other document. Chains are cut at long gaps
and carried back to the two texts, where the words of both spans, drawn out over equal words, are
aligned by edit distance. What has RUN words or more on both sides at a similarity of at least
SIMILARITY is a passage; a chain that fails as a whole is tried in pieces cut at shorter gaps.

Null text, and text of fewer than MIN_WORDS words, has none; documents without doc_id take no part; a
table without rows gives none. doc_id is a whole number. Rows with one doc_id are one document, and of
differing texts the most similar counts. Exact copies share one passage, their whole text. The nth
place of a seed or run in a document meets the nth places elsewhere; a run's further places meet the
first places too, unless the run before is equal. Of tied chains the earlier is taken first. Texts are
read whole. Only doc_id and text are read; other columns, whatever their names, are left out.

What may be missed: an edited passage without RUN equal words, where neighbours in order of doc_id
differ from seed to seed, and what a text loops more often than the earlier one does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.llm.common import read, small, table

GRAM, WINDOW = 5, 8
MIN_WORDS, SIMILARITY = 50, 0.8
#: Most words between anchors of one passage and of a piece of it, and the price of a word of gap on either side, in words covered.
MAX_GAP, PIECE_GAP, GAP_COST = 40, 12, 0.2
#: Words by which another chain must be better for an anchor to leave its own diagonal.
SLACK = 16
MIN_ANCHORS = 4
#: Words of a run: what any MIN_WORDS equal words hold from their first seed on.
RUN = MIN_WORDS - (WINDOW - 1)
#: Words on either side of a span, over which it is drawn out where they are equal.
MARGIN = 64
#: One document in SAMPLE is looked at for hot seeds: those that a HOT_SHARE of them and HOT_LEAST at least hold.
SAMPLE, HOT_SHARE, HOT_LEAST = 64, 0.005, 50
#: Documents a salt of hot seeds: salts hang on the documents alone, so rows are the same under any settings.
SALT_DOCS = 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_UNDO = np.uint64(pow(int(_ODD), -1, 1 << 64))


def word_hashes(data: bytes) -> np.ndarray:
    known: dict[bytes, int] = {}
    words = data.lower().split()
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    own = np.fromiter((zlib.crc32(w) << 32 | zlib.adler32(w) for w in known), np.uint64, len(known))
    return own[ids] if len(ids) else np.empty(0, np.uint64)


def _nth(value: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(value, kind="stable")
    own = value[order]
    begin = np.r_[True, own[1:] != own[:-1]]
    out = np.empty(len(value), np.int64)
    out[order] = np.arange(len(value)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _MIX
    return x ^ x >> np.uint64(32)


def seeds(data: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word position, words) of a text's winnowed grams and of the runs that begin at them."""
    h = word_hashes(data or b"")
    n = len(h) - GRAM + 1
    if len(h) < MIN_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    g = np.zeros(n, np.uint64)
    for d in range(GRAM):
        g = g * _ODD + h[d : d + n]
    g = _mixed(g)
    at = np.lib.stride_tricks.sliding_window_view(g, WINDOW).argmin(axis=1) + np.arange(n - WINDOW + 1)
    at = np.unique(at)
    begin = at[at + RUN <= len(h)]
    # hashes of all the words of a run, from sums over prefixes
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(h), _ODD)], dtype=np.uint64)
    back = np.cumprod(np.full(len(h), _UNDO), dtype=np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(h * back, dtype=np.uint64)]
    run = _mixed((total[begin + RUN] - total[begin]) * power[begin + RUN] + np.uint64(RUN))
    nth = _nth(run)
    again = (nth > 0) & np.r_[True, run[1:] != run[:-1]][: len(run)]
    key = np.concatenate([g[at] + _nth(g[at]).astype(np.uint64) * _ODD, run + nth.astype(np.uint64) * _ODD, run[again]])
    pos = np.concatenate([at, begin, begin[again]])
    words = np.concatenate([np.full(len(at), GRAM), np.full(len(begin) + int(again.sum()), RUN)])
    return key.view(np.int64), pos.astype(np.int32), words.astype(np.int32)


def _seed_rows(hot: np.ndarray, salts: int):
    """Rows of every seed and run; those in hot (sorted) get a key of their document's salt and keep their own as hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = [seeds(x) for x in part.column(1).to_pylist()]
                doc = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(v) for v, _, _ in found]).astype(np.int64)
                key, pos, words = (np.concatenate(x) for x in zip(*found))
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    is_hot = hot[place] == key
                    salt = _mixed(doc.view(np.uint64)) % np.uint64(salts) + np.uint64(1)
                    salted = np.where(is_hot, _mixed(key.view(np.uint64) + salt * _MIX).view(np.int64), key)
                    own = pa.array(key, mask=~is_hot)
                else:
                    salted, own = key, pa.nulls(len(key), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(salted), pa.array(doc), pa.array(pos), pa.array(words), own], names=["seed", "doc", "pos", "words", "hot"])

    return run


_OCCURRENCE = "seed long, doc long, pos int, words int, hot long"
_MATCH = "doc long, other long, pos int, other_pos int, words int, hot long"


def _match_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of occurrences in order of seed and doc, and each hot seed's representative, with no other.

    What one batch needs of the last is one seed's first and last row.
    """
    last = None
    for b in batches:
        seed, doc, pos, words = (c.to_numpy(zero_copy_only=False) for c in b.columns[:4])
        if not len(seed):
            continue
        hot = b.column(4)
        begins = np.r_[True, seed[1:] != seed[:-1]]
        if last is not None and last[0] == seed[0]:
            begins[0] = False
        head = np.maximum.accumulate(np.where(begins, np.arange(len(seed)), -1))
        kept_doc, kept_pos = (0, 0) if last is None else last[1:3]
        rep_doc, rep_pos = np.where(head < 0, kept_doc, doc[head]), np.where(head < 0, kept_pos, pos[head])
        prev_doc, prev_pos = np.r_[0 if last is None else last[3], doc[:-1]], np.r_[0 if last is None else last[4], pos[:-1]]
        first = ~begins & (rep_doc != doc)
        second = first & (prev_doc != rep_doc) & (prev_doc != doc) & (words == GRAM)
        reps = begins & ~hot.is_null().to_numpy(zero_copy_only=False)
        cols = [np.concatenate([x[first], y[second], z[reps]]) for x, y, z in ((doc, doc, doc), (rep_doc, prev_doc, doc), (pos, pos, pos), (rep_pos, prev_pos, pos), (words, words, words))]
        keys = pa.concat_arrays([pa.nulls(len(cols[0]) - int(reps.sum()), pa.int64()), hot.filter(pa.array(reps))])
        last = (seed[-1], rep_doc[-1], rep_pos[-1], doc[-1], pos[-1])
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))), keys], names=[c.split()[0] for c in _MATCH.split(", ")])


def anchors(x: np.ndarray, y: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of matches, and of steps along each run that the next run does not go on with; x rises, y falls where x ties."""
    runs = words > GRAM
    rx, ry, rw = x[runs], y[runs], words[runs]
    order = np.lexsort((rx, rx.astype(np.int64) - ry))
    rx, ry, rw = rx[order], ry[order], rw[order]
    goes_on = np.r_[(np.diff(rx.astype(np.int64) - ry) == 0) & (np.diff(rx) <= WINDOW), False][: len(rx)]
    step = [np.r_[np.arange(WINDOW, w - GRAM, WINDOW), w - GRAM] for w in rw[~goes_on].tolist()]
    size = [len(s) for s in step]
    step = np.concatenate(step) if step else np.empty(0, np.int64)
    x = np.r_[x, np.repeat(rx[~goes_on], size) + step].astype(np.int64)
    y = np.r_[y, np.repeat(ry[~goes_on], size) + step].astype(np.int64)
    both = np.unique(x << 32 | (1 << 32) - 1 - y)
    return both >> 32, (1 << 32) - 1 - (both & (1 << 32) - 1)


def chain(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Indexes of each best chain of anchors, x and y rising; x is sorted and y falls where x ties.

    An anchor counts the words that it covers beyond the one before it on its diagonal, WINDOW at most.
    """
    if len(x) == 1 or (np.diff(y) > 0).all() and (np.diff(x) > 0).all():
        return [np.arange(len(x))]
    by = np.lexsort((x, x - y))
    step = np.diff(x[by])
    same = (np.diff((x - y)[by]) == 0) & (step <= MAX_GAP)
    before, weight = np.full(len(x), -1), np.full(len(x), float(GRAM))
    before[by[1:][same]] = by[:-1][same]
    weight[by[1:][same]] = np.minimum(step[same], WINDOW)
    rank = np.searchsorted(np.unique(y), y) + 1
    size = int(rank.max())
    # tree[k] has the best score, before gaps are paid, and its anchor among the ranks that node k covers
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, back = [0.0] * len(x), [-1] * len(x)
    for i, (a, b, r, own, w) in enumerate(zip(x.tolist(), y.tolist(), rank.tolist(), before.tolist(), weight.tolist())):
        best, k = (-1e18, -1), r - 1
        while k:
            best, k = max(best, tree[k]), k & (k - 1)
        if own >= 0:
            stay = score[own] + GAP_COST * int(x[own] + y[own])
            if stay >= best[0] - SLACK:
                best = (stay, own)
        gain = best[0] - GAP_COST * (a + b)
        score[i] = w + max(gain, 0.0)
        if gain > 0:
            back[i] = best[1]
        node, k = (score[i] + GAP_COST * (a + b), i), r
        while k <= size:
            tree[k], k = max(tree[k], node), k + (k & -k)
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: -score[i]):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = back[i]
        if own:
            out.append(np.array(own[::-1]))
    return out


def cut(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """(start, end, other start, other end, anchors, part, piece) of a chain's parts between long gaps and of their pieces.

    Pieces have their part's number; what is too short for a passage even with its margins goes.
    """
    gap = np.maximum(np.diff(x), np.diff(y)) if len(x) > 1 else np.empty(0, np.int64)
    out = []
    for part, own in enumerate(np.split(np.arange(len(x)), np.flatnonzero(gap > MAX_GAP) + 1)):
        inner = np.flatnonzero(gap[own[0] : own[-1]] > PIECE_GAP + GRAM) + 1
        for k, piece in enumerate([own, *(np.split(own, inner) if len(inner) else ())]):
            a, b = x[piece], y[piece]
            span = min(a[-1] - a[0], b[-1] - b[0]) + GRAM
            if len(piece) >= MIN_ANCHORS and span >= RUN - 2 * WINDOW:
                out.append((int(a[0]), int(a[-1]) + GRAM, int(b[0]), int(b[-1]) + GRAM, len(piece), part, k > 0))
    return out


_SPAN = "doc_id long, start_word int, end_word int, other_id long, other_start int, other_end int, n_anchors int, part long, piece boolean"


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chained spans of runs of equal (doc, other); a run may go on in the next batch."""
    held: list = []
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in _SPAN.split(", ")]

    def found(doc, other, pos, other_pos, words):
        first = np.r_[0, np.flatnonzero((np.diff(doc) != 0) | (np.diff(other) != 0)) + 1]
        size = np.diff(np.r_[first, len(doc)])
        rows = []
        enough = (size >= MIN_ANCHORS) | (np.maximum.reduceat(words, first) > GRAM)
        for at, n in zip(first[enough].tolist(), size[enough].tolist()):
            x, y = anchors(pos[at : at + n], other_pos[at : at + n], words[at : at + n])
            for k, own in enumerate(chain(x, y)):
                rows += [(doc[at], p[0], p[1], other[at], *p[2:5], (k << 32) + p[5], p[6]) for p in cut(x[own], y[own])]
        cols = list(zip(*rows)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns[:5]]
        held.append(new)
        doc = new[0][-1]
        if held[0][0][0] == doc:  # one document so far
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        at = int(np.searchsorted(cols[0], doc))
        held = [[c[at:] for c in cols]]
        yield found(*(c[:at] for c in cols))
    if held:
        yield found(*(np.concatenate(c) for c in zip(*held)))


def distance(a: list, b: list) -> int:
    """Least insertions, deletions and replacements that turn a into b; a step of bit operations for each item of b."""
    if not a or not b:
        return max(len(a), len(b))
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, top, up, down, total = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for w in b:
        here = where.get(w, 0)
        diagonal = (((here & up) + up) ^ up) | here | down
        rise, fall = down | full & ~(diagonal | up), up & diagonal
        total += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | full & ~(diagonal | rise), rise & diagonal
    return total


def align(a: list, a_at: int, a_end: int, b: list, b_at: int, b_end: int) -> tuple[int, int, int, int, float]:
    """Bounds of two spans, given in word lists with margins, drawn out over equal words, and their similarity."""
    while a_at and b_at and a[a_at - 1] == b[b_at - 1]:
        a_at, b_at = a_at - 1, b_at - 1
    while a_end < len(a) and b_end < len(b) and a[a_end] == b[b_end]:
        a_end, b_end = a_end + 1, b_end + 1
    x, y = a[a_at:a_end], b[b_at:b_end]
    most = max(len(x), len(y))
    if x == y:
        return a_at, a_end, b_at, b_end, 1.0 if most else 0.0
    left = next((k for k, (v, w) in enumerate(zip(x, y)) if v != w), min(len(x), len(y)))
    x, y = x[left:], y[left:]
    right = next((k for k, (v, w) in enumerate(zip(x[::-1], y[::-1])) if v != w), min(len(x), len(y)))
    return a_at, a_end, b_at, b_end, 1 - distance(x[: len(x) - right], y[: len(y) - right]) / most


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each wanted span of a text, with MARGIN words on either side, and how many stand before the span."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            rows = []
            for doc, data, spans in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                words = data.lower().split()
                for span in spans:
                    low = max(0, span["start"] - MARGIN)
                    rows.append((doc, span["start"], span["end"], span["start"] - low, b" ".join(words[low : span["end"] + MARGIN])))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["doc", "start", "end", "before", "words"])


_PASSAGE = "doc_id long, start_word int, end_word int, other_id long, other_start int, other_end int, n_anchors int, part long, piece boolean, from int, other_from int, similarity double"


def _aligned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages among spans with the words of both sides; from tells where the span began before it was drawn out."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.float64())
    names = [c.split()[0] for c in _PASSAGE.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = []
            for doc, start, end, other, o_start, o_end, n, part, piece, a_before, a, b_before, b in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                a, b = a.split(), b.split()
                a0, a1, b0, b1, likeness = align(a, a_before, min(len(a), a_before + end - start), b, b_before, min(len(b), b_before + o_end - o_start))
                if likeness >= SIMILARITY and min(a1 - a0, b1 - b0) >= RUN:
                    a_low, b_low = start - a_before, o_start - b_before
                    rows.append((doc, a_low + a0, a_low + a1, other, b_low + b0, b_low + b1, n, part, piece, start, o_start, likeness))
            cols = list(zip(*rows)) or [()] * 12
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def hot_seeds(given: DataFrame) -> tuple[np.ndarray, int]:
    """Sorted keys that a share of the sampled documents hold, at most the seeds of 1 / HOT_SHARE documents, and the salts that their documents are dealt over."""
    some = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    n = some.count()
    least = max(HOT_LEAST, HOT_SHARE * n)
    rows = some.mapInArrow(_seed_rows(np.empty(0, np.int64), 1), _OCCURRENCE).groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r[0] for r in rows.select("seed").collect()], np.int64)), max(16, n * SAMPLE // SALT_DOCS)


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, other_id, other_start, other_end, n_anchors, similarity) of passages shared with an earlier document."""
    given = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    hot, salts = hot_seeds(given)
    occurrences = given.mapInArrow(_seed_rows(hot, salts), _OCCURRENCE)
    meet = lambda rows: rows.repartition("seed").sortWithinPartitions("seed", "doc", "pos").mapInArrow(_match_rows, _MATCH)
    matches = meet(occurrences)
    if len(hot):
        first = table(matches, "matches")
        reps = first.where("hot is not null").select(F.col("hot").alias("seed"), "doc", "pos", "words", F.lit(None).cast("long").alias("hot"))
        matches = first.where("hot is null").unionByName(meet(reps))
    spans = table(matches.drop("hot").repartition("doc").sortWithinPartitions("doc", "other", "pos").mapInArrow(_span_rows, _SPAN), "spans")
    # the words of each distinct span, cut out where its document is, then carried to the pairs
    sides = [spans.select(F.col(d).alias("doc"), F.col(s).alias("start"), F.col(e).alias("end")) for d, s, e in (("doc_id", "start_word", "end_word"), ("other_id", "other_start", "other_end"))]
    wanted = sides[0].union(sides[1]).distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = given.withColumnRenamed("doc_id", "doc").join(small(table(wanted, "wanted-spans"), 500_000), "doc").select("doc", "text", "spans")
    words = table(texts.mapInArrow(_word_rows, "doc long, start int, end int, before int, words binary"), "span-words")
    side = lambda names, to: words.select(*(F.col(c).alias(n) for c, n in zip(("doc", "start", "end", "before", "words"), (*names, *to))))
    own, others = ("doc_id", "start_word", "end_word"), ("other_id", "other_start", "other_end")
    pairs = spans.join(side(own, ("a_before", "a")), list(own)).join(side(others, ("b_before", "b")), list(others))
    names = [c.split()[0] for c in _SPAN.split(", ")]
    found = pairs.select(*names, "a_before", "a", "b_before", "b").mapInArrow(_aligned_rows, _PASSAGE)
    # of repeated rows of a document the most similar counts; of a part that holds as a whole its pieces go
    given_by = ["doc_id", "other_id", "part"]
    rest = ("start_word", "end_word", "other_start", "other_end", "n_anchors")
    best = found.repartition(*given_by).groupBy(*given_by, "piece", "from", "other_from").agg(F.max(F.struct("similarity", *rest)).alias("best"))
    holds = F.max(~F.col("piece")).over(Window.partitionBy(*given_by))
    best = best.withColumn("holds", holds).where(F.col("piece") != F.col("holds"))
    return best.select("doc_id", "best.start_word", "best.end_word", "other_id", "best.other_start", "best.other_end", "best.n_anchors", "best.similarity")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
