"""Spelling variants: words one edit apart, found by pivotal grams.

Words are runs of letters, lower-cased in A-Z; of one occurrence in 97, by a checksum, one letter is lost.
The vocabulary holds words of enough letters and occurrences. Bigrams are ordered by how few words of
the vocabulary have them; a word's prefix is its three first in that order, with all that equal the
third. Two disjoint bigrams of the prefix, the rarest such pair by dynamic programming over places, are
its pivots. One edit leaves one pivot whole, and of two words one edit apart one has such a pivot in
the other's prefix. The edit then lies on one side of the pivot: the other side is equal and the lengths
differ by one at most, so a pivot meets the prefix bigrams of equal left or right part and of lengths
next to its own. Keys that many words share (HOT) are split by the first or last half of the part that holds
the edit, of which one is equal too; whoever meets is verified by edit distance.

Null text has no words, empty texts and an empty table give none. A null doc_id is the empty string in the
checksum. Repeated rows count each time. Texts are read whole, words of any length are taken. Ties of
neighbours go to the word that is first in code-point order. Columns other than doc_id and text play
no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm.common import UPPER, lower_ascii, read, small, table

LETTERS, LEAST_LETTERS, LEAST_TIMES, ONE_IN, TIMES_MORE = "a-zÀ-ÿ", 5, 3, 97, 2
#: One edit: three bigrams in a prefix, two pivots.
EDITS, GRAM = 1, 2
#: Rows of a key from which on it is split by halves.
HOT = 256


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of docs(doc_id, text)."""
    runs = docs.where("text is not null").select(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("of"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run")
    )
    h = F.crc32(F.concat("of", "run").cast("binary"))
    marked = runs.select("run", h.alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    word = F.when(F.col("h") % ONE_IN == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    counted = marked.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.char_length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_TIMES))


def prefix(word: str, often: dict[str, int]) -> list[tuple[int, str, int]]:
    """(words that have it, bigram, place) of the prefix, in order."""
    grams = sorted((often.get(g := word[i : i + GRAM], 0), g, i) for i in range(len(word) - GRAM + 1))
    need = GRAM * EDITS + 1
    return [x for x in grams if x[:2] <= grams[min(need, len(grams)) - 1][:2]]


def pivots(own: list[tuple[int, str, int]]) -> list[int]:
    """Places of the EDITS + 1 disjoint bigrams of a prefix that fewest words have, by dynamic programming over places."""
    own = sorted(own, key=lambda x: x[2])
    # best[k]: (cost, places) of k bigrams chosen so far, kept for each place from which on the next may begin
    best: list[list[tuple[int, tuple[int, ...]]]] = [[(0, ())] + [(1 << 62, ())] * (EDITS + 1)]
    ends: list[int] = [-1]
    for cost, _, at in own:
        before = max(i for i, e in enumerate(ends) if e <= at)  # last state whose bigrams end before this one
        row = list(best[-1])
        for k in range(EDITS + 1):
            was = best[before][k]
            row[k + 1] = min(row[k + 1], (was[0] + cost, (*was[1], at)))
        best.append(row)
        ends.append(at + GRAM)
    return list(best[-1][EDITS + 1][1])


def _choose(often: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = prefix(word, often)
                chosen = set(pivots(own))
                out += [(word, n, at, at in chosen) for _, _, at in own]
            cols = [pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 4, (pa.string(), pa.int64(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "n", "at", "pivot"])

    return run


def chosen_grams(words: DataFrame) -> DataFrame:
    """(word, n, at, pivot) of each prefix bigram of words(word, n). Counts of bigrams, at most the square of the letters, reach the driver."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - GRAM + 1), lambda i: F.substring("word", i, GRAM))).alias("gram"))
    often = Counter(dict(map(tuple, grams.groupBy("gram").agg(F.count("*")).collect())))
    return words.mapInArrow(_choose(dict(often)), "word string, n long, at int, pivot boolean")


def _part(side: str) -> Column:
    """A bigram with all on its side of the word."""
    length = F.char_length("word")
    return F.substring("word", F.lit(1), F.col("at") + GRAM) if side == "L" else F.substring("word", F.col("at") + 1, length)


def _rest(side: str) -> tuple[Column, Column, Column]:
    """Where the other side begins (from 1) and ends, and its length in the shorter of two words of lengths short and len."""
    if side == "L":
        return F.col("at") + GRAM + 1, F.col("len"), F.col("short") - F.col("at") - GRAM
    return F.lit(1), F.col("at"), F.col("at") + F.col("short") - F.col("len")


def _lengths() -> Column:
    return F.explode(F.array(F.col("len") - 1, F.col("len"), F.col("len") + 1))


def _sided(grams: DataFrame, pivot: bool) -> DataFrame:
    """(key, word, n, side, at, len, other): pivots for each length next to their own, other; prefix bigrams for their own."""
    rows = (grams.where("pivot") if pivot else grams).withColumn("len", F.char_length("word"))
    rows = rows.withColumn("other", _lengths() if pivot else F.col("len"))
    sides = [rows.select(F.xxhash64(F.lit(x), _part(x), "other").alias("key"), "word", "n", F.lit(x).alias("side"), "at", "len", "other") for x in "LR"]
    return sides[0].union(sides[1])


def _halved(rows: DataFrame, pivot: bool) -> DataFrame:
    """(key, word, n) of rows, by the half of the other side that is equal too."""
    rows = rows.withColumn("other", F.col("other") if pivot else _lengths()).withColumn("short", F.least("len", "other"))
    out = []
    for side in "LR":
        begin, end, m = _rest(side)
        half = (m / 2).cast("int")
        parts = F.array(
            F.struct(F.lit("first").alias("half"), F.substring("word", begin, half).alias("text")),
            F.struct(F.lit("last").alias("half"), F.substring("word", end - (m - half) + 1, m - half).alias("text")),
        )
        cut = rows.where((F.col("side") == side) & (m >= 0)).withColumn("part", F.explode(parts))
        # both words' lengths, the shorter first, so that they cut at the same place
        out.append(cut.select(F.xxhash64("key", "short", F.greatest("len", "other"), "part.half", "part.text").alias("key"), "word", "n"))
    return out[0].union(out[1])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, m): every pair of words(word, n) one edit apart, both ways, with the counts of both; a written table."""
    grams = table(chosen_grams(words), "grams")
    own, others = _sided(grams, True), _sided(grams, False)
    often = own.union(others).groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") >= HOT).select("key")
    often = small(table(often, "frequent-keys"), 1_000_000)

    def keyed(rows, pivot):
        marked = rows.join(often.withColumn("hot", F.lit(True)), "key", "left")
        return marked.where("hot is null").select("key", "word", "n").union(_halved(marked.where("hot"), pivot))

    a = keyed(own, True)
    b = keyed(others, False).select("key", F.col("word").alias("near"), F.col("n").alias("m"))
    met = a.join(b, "key").where("word <> near").where(F.levenshtein("word", "near", EDITS) == EDITS).select("word", "n", "near", "m").distinct()
    met = table(met, "near-words")
    return met.union(met.select("near", "m", "word", "n")).distinct()


def forms(words: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near) of words(word, n)."""
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    out = words.join(best, "word", "left").withColumn("m", -F.col("best.less"))
    taken = F.col("m") >= TIMES_MORE * F.col("n")
    return out.select("word", "n", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, F.col("m")).alias("form_n"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def roots(of: DataFrame) -> DataFrame:
    """(word, root) of each of(word, form) that has a form: the last of its forms. A form has more occurrences than its word, so rounds double the steps until none changes."""
    now = table(of.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        then = small(now.select(F.col("word").alias("root"), F.col("root").alias("further")), 1_000_000)
        after = table(now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variant_groups(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of docs(doc_id, text)."""
    words = table(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    of = table(forms(words), "forms")
    out = of.join(small(roots(of), 1_000_000), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(read(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents
  ) GROUP BY doc_id, run
), coded AS (
  SELECT run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 | (ord(c)::BIGINT >> 6), 128 | (ord(c)::BIGINT & 63)] END)) AS b FROM runs
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM coded, bits
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {ONE_IN} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
  ) WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(times) >= {LEAST_TIMES}
), cut AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS o FROM near
), forms AS (
  SELECT w.word, w.n, CASE WHEN m >= {TIMES_MORE} * w.n THEN near END AS form, CASE WHEN m >= {TIMES_MORE} * w.n THEN m END AS form_n, coalesce(n_near, 0) AS n_near
  FROM words w LEFT JOIN (SELECT * FROM best WHERE o = 1) b ON b.word = w.word
), steps AS (
  SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT s.word, f.form, s.step + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, coalesce(s.root, f.word) AS root, f.n, f.n_near, f.form_n
FROM forms f LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word) s ON s.word = f.word
""".replace("WITH bits", "WITH RECURSIVE bits", 1)
