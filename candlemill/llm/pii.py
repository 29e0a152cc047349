"""Personal data by base patterns and bootstrapped contextual extraction, with DataFrame functions alone.

Base spans (e-mail, IP, card, phone) are seeds. A seed's lexical patterns are the word on its left, the
two words on its left, the word on its right, all lower-cased, and its own shape (letters and digits
run together). Identifier-like strings of one or several tokens that touch no seed (numbers in groups
however spaced or bracketed, addresses with "at" and "dot" spelled out, words with digits or @) are
the unknown instances. Scores pass over the graph of patterns and instances: a pattern's confidence
for a kind is the mean score of its instances, less by PRIOR doubtful ones, an instance's score the
noisy-or of its patterns. After ROUNDS, context patterns with MIN_SEEDS distinct seeds and enough
confidence name the unknown instances that stand in them; shapes only pass scores on.

Null or empty text has no spans, nor has an empty table. Offsets are code points, ends exclusive. A
document's results depend on the corpus through the patterns only; equal rows get equal results. Of
kinds that tie in confidence the last by name is taken. Texts, contexts and shapes are read whole,
however long. Other columns pass through; those named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.llm.common import boxed, let, read, row_key, small, table

#: Base patterns. A start is tried only where it can be leftmost, and what cannot give back is possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Strings that could be identifiers: spelled-out addresses, else a token with a digit or @ and the groups of digits after it.
_AT = r"(?: at | ?\(at\) ?| ?\[at\] ?)"
_DOT = r"(?:\.| dot | ?\(dot\) ?| ?\[dot\] ?)"
TOKEN = (
    r"(?<![A-Za-z0-9@._%+-])(?:[A-Za-z0-9._%+-]++" + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)++"
    r"|\(?[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+(?:\)?[ /-]?\(?[0-9][A-Za-z0-9@._%+-]*+)*+)"
)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
ROUNDS, MIN_SEEDS, CONFIDENCE, PRIOR = 3, 5, 0.9, 0.5
#: Pattern nodes that may name an instance; the shape is one more, which only passes scores on.
CONTEXTS = ("left", "left2", "right")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, i):
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    return (
        F.when(kind == "ip", match.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"))
        .when(kind == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Matches in order with the length of the gap before each and its neighbour words.

    A gap is cut into words once, from whole; a first or last word is what stands next to the match.
    """

    def gap(g):
        words = F.split(F.lower(F.trim(F.regexp_replace(g, r"\s+", " "))), " ", -1)
        return let(words, lambda w: F.struct(F.char_length(g).cast("long").alias("size"), F.get(w, F.lit(0)).alias("first"), F.element_at(w, -1).alias("last"), F.when(F.size(w) > 1, F.concat_ws(" ", F.element_at(w, -2), F.element_at(w, -1))).alias("last2")))

    def row(gaps):
        def one(m, i):
            before, after = F.get(gaps, i), F.get(gaps, i + 1)
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), before["size"].alias("gap"), F.char_length(m).cast("long").alias("size"), m.alias("match"),
                before["last"].alias("left"), before["last2"].alias("left2"), after["first"].alias("right"),
            )

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)

    parts = F.split(text, pattern, -1)
    return let(F.when(F.size(parts) > 1, F.transform(parts, gap)), row)


def candidates(docs: DataFrame) -> DataFrame:
    """(key, kind, start, end, match, left, left2, right): base spans that hold, and other strings under kind token."""
    text = F.col("text")
    arrays = [F.coalesce(_found(text, k, p), F.array()) for k, p in (*PATTERNS.items(), ("token", TOKEN))]
    rows = docs.where("text is not null").select(row_key().alias("key"), F.explode(F.concat(*arrays)).alias("m")).select("key", "m.*")
    rows = rows.repartition("key").dropDuplicates(["key", "kind", "i"])
    upto = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    own = F.regexp_replace("match", r"[._%+-]+$", "")
    rows = rows.withColumn("match", F.when(F.col("kind") == "token", own).otherwise(F.col("match")))
    rows = rows.withColumn("end", F.col("start") + F.char_length("match")).where(valid(F.col("kind"), F.col("match")))
    at = Window.partitionBy("key").orderBy("start", "end")
    base = F.col("kind") != "token"
    before = F.max(F.when(base, F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, -1))
    # rows from here on; the first of them that is a base span starts least
    after = F.min(F.when(base, F.col("start"))).over(at.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"before": before, "after": after})
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end")))
    return rows.where(base | free).select("key", "kind", "start", "end", "match", *CONTEXTS)


def shape(match: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(match, "[A-Za-z]+", "a"), "[0-9]+", "0")


def learn(found: DataFrame) -> DataFrame:
    """(side, word, kind, confidence) of the context patterns that name unknown instances."""
    nodes = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("word")) for c in CONTEXTS), F.struct(F.lit("shape").alias("side"), shape(F.col("match")).alias("word"))))
    edges = found.select(F.md5("match").alias("who"), "kind", nodes.alias("p")).select("who", "kind", "p.side", "p.word")
    edges = edges.where("word is not null and word <> ''").withColumn("word", F.md5("word"))
    edges = table(edges.groupBy("side", "word", "who").agg(F.max(F.when(F.col("kind") != "token", F.col("kind"))).alias("seed")), "pattern-graph")
    size = edges.groupBy("side", "word").agg(F.count("*").alias("size"))
    score = edges.where("seed is not null").select("who", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    seeds, patterns = score, None
    for _ in range(ROUNDS):
        mass = edges.join(score, "who").groupBy("side", "word", "kind").agg(F.sum("score").alias("mass"), F.count(F.when(F.col("seed") == F.col("kind"), 1)).alias("seeds"))
        patterns = mass.where(F.col("seeds") >= MIN_SEEDS).join(size, ["side", "word"]).withColumn("confidence", F.col("mass") / (F.col("size") + PRIOR))
        patterns = table(patterns.select("side", "word", "kind", "seeds", "confidence"), "patterns")
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        new = edges.where("seed is null").join(small(patterns, 500_000), ["side", "word"]).groupBy("who", "kind").agg((1 - F.exp(doubt)).alias("score"))
        score = seeds.unionByName(new)
    return patterns.where((F.col("confidence") >= CONFIDENCE) & (F.col("side") != "shape")).select("side", "word", "kind", "confidence")


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, kind, start, end, base) of all spans, and the patterns behind those that are not base; word is a digest there."""
    found = table(candidates(docs), "candidates")
    patterns = table(learn(found), "sure-patterns")
    unknown = found.where("kind = 'token'").select("key", "start", "end", F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.md5(c).alias("word")) for c in CONTEXTS))).alias("p"))
    named = unknown.select("key", "start", "end", "p.*").join(small(patterns, 500_000), ["side", "word"])
    best = named.groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    spans = found.where("kind <> 'token'").select("key", "kind", "start", "end", F.lit(True).alias("base"))
    return spans.unionByName(best.withColumn("base", F.lit(False))), patterns


def digest(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with counts and spans of each row."""
    spans, _ = find(docs)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    said = F.concat_ws(":", "kind", "start", "end")
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["said"]), ",")
    item = F.struct(F.col("start"), rank.alias("rank"), said.alias("said"))
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"__{k}") for k in KINDS]
    per = spans.groupBy("key").agg(*counts, line(F.when(F.col("base"), item)).alias("__base"), line(item).alias("__all"))
    per = small(table(per, "spans"), 200_000)
    names = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")
    out = boxed(docs, row_key().alias("key"), without=names).join(per, "key", "left")
    return out.select(
        "row.*",
        *(F.coalesce(f"__{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("__base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("__all", F.lit("")).alias("spans"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
