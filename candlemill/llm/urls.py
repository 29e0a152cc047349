"""URL filtering by rules and by the empirical-Bayes reputation of hosts, with DataFrame functions alone.

Each labelled page is a trial that fails if it is toxic or of low quality. Failure rates shrink
level by level: a host's beta prior has its registered domain's posterior mean, a domain's its
suffix's, a suffix's the overall rate; each level's prior weight comes from the spread of that
level's rates (method of moments). A page is blocked if its host's failure rate lies above MAX_RATE
with a posterior probability of 1 - RISK or more, by the beta distribution itself at any number of
trials, unless a rule decides. A host without labels has the prior that the nearest
level with labels gives it, with the prior weight of the level below: its domain's, else its suffix's,
else the overall rate. The suffix is the last label, or the last two where a country's label stands
behind one of SECOND_LEVEL; the registered domain has one label more. A host that is no more than a
suffix, or an address of digits, is its own domain and suffix; user and port are no part of either.

Null urls, and urls without ://, have empty host and path and are allowed; so is an empty host. Pages
and labels may repeat; several labels of a page count as failed if any does, a label without doc_id or
outcome is none. Without labels every page that no rule decides is allowed, and no pages give no rows.
A probability that ties with the bound blocks. Long urls are read whole. Only page_id and url, and
doc_id, quality and toxic, are read; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm.common import let, lower_ascii, read, small, table

#: (host and path prefix, verdict), as the query's contract lists them.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MAX_RATE, RISK = 0.5, 0.05
#: Steps of the continued fraction: some, and so many a root of the trials, as its convergence asks for at any size.
STEPS, STEPS_ROOT = 100, 6
#: Bounds of a prior's weight in trials, and its value where rates show no spread to fit.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
LEVELS = ("suffix", "domain", "host")
#: Labels under which country registries give out names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "govt", "gr", "lg", "ltd", "me", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "sch", "school")
#: Coefficients of Lanczos' approximation of the gamma function (g = 7, nine terms); fixed values.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _keys(host: Column) -> dict[str, Column]:
    """A host's key at each level."""
    name = F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", "")
    parts = F.filter(F.split(name, r"\.", -1), lambda x: x != "")
    n, last, second = F.size(parts), F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    wide = F.when((n > 1) & (F.char_length(last) == 2) & second.isin(*SECOND_LEVEL), 2).otherwise(1)
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")
    own = name.rlike(r"^[0-9.]*$|^\[") | (n <= wide)
    return {"suffix": F.when(own, name).otherwise(tail(wide)), "domain": F.when(own, name).otherwise(tail(wide + 1)), "host": host}


def _log_gamma(x: Column) -> Column:
    """Of x > 0, through the gamma function at x + 1."""
    total = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (x + k)
    t = x + 7.5
    return 0.9189385332046727 + (x + 0.5) * F.log(t) - t + F.log(total) - F.log(x)


def _fraction(a: Column, b: Column, x: float) -> Column:
    """Lentz' evaluation of the continued fraction of the incomplete beta function."""
    safe = lambda v: F.when(F.abs(v) < 1e-30, F.lit(1e-30)).otherwise(v)
    first = 1 / safe(1 - (a + b) * x / (a + 1))
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def half(s, k):
        return let(s, lambda s: let(1 / safe(1 + k * s["d"]), lambda d: let(safe(1 + k / s["c"]), lambda c: state(c, d, s["h"] * d * c))))

    def step(s, m):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(half(s, even), odd)

    steps = F.transform(F.sequence(F.lit(1), F.lit(STEPS) + F.ceil(STEPS_ROOT * F.sqrt(a + b)).cast("int")), lambda m: m.cast("double"))
    return F.aggregate(steps, state(F.lit(1.0), first, first), step)["h"]


def beta_cdf(a: Column, b: Column, x: float) -> Column:
    """Probability of at most x, 0 < x < 1, under beta(a, b) with a, b > 0."""
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(F.lit(x)) + b * F.log(F.lit(1 - x)))
    exact = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when((a <= 0) | (b <= 0), F.when(a <= 0, 1.0).otherwise(0.0)).otherwise(exact)


def reputation(outcomes: DataFrame) -> tuple[DataFrame, float, float]:
    """(level, key, rate, a, b) of outcomes(host, failed 0/1), the overall rate and the weight of a suffix's prior.

    Rate and beta parameters are for hosts of that key which have no labels at the levels below.

    The counts of a host, the least of the levels, are summed before anything meets in one place.
    """
    host = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("failed").alias("failed"))
    keys = _keys(F.col("host"))
    host = table(host.withColumns({k: keys[k] for k in LEVELS[:-1]}), "hosts")
    n, failed = host.agg(F.sum("n"), F.sum("failed")).first()
    overall = float(failed) / n if n else 0.0
    up, posteriors, weights = None, [], []
    for k, level in enumerate(LEVELS):
        keys = list(LEVELS[: k + 1])
        own = host.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))
        own = own.withColumn("prior", F.lit(overall)) if up is None else own.join(up, keys[:-1])
        # moments: the spread of rates around their priors beyond what binomial noise gives
        noise = F.col("prior") * (1 - F.col("prior"))
        spread = own.where(noise > 0).agg(F.sum(F.pow(F.col("failed") / F.col("n") - F.col("prior"), 2) * F.col("n")).alias("ss"), F.sum(noise).alias("noise"), F.sum((F.col("n") - 1) * noise).alias("scale")).first()
        between = (spread["ss"] - spread["noise"]) / spread["scale"] if spread["scale"] else 0.0
        weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / between - 1)) if between > 0 else MOST_WEIGHT
        a, b = F.col("failed") + weight * F.col("prior"), F.col("n") - F.col("failed") + weight * (1 - F.col("prior"))
        own = own.withColumns({"a": a, "b": b}).withColumn("rate", F.col("a") / (F.col("a") + F.col("b")))
        up = own.select(*keys, F.col("rate").alias("prior"))
        posteriors.append(own.select(F.lit(level).alias("level"), F.col(level).alias("key"), "rate", "a", "b"))
        weights.append(weight)
    out = None
    for own, below in zip(posteriors, [*weights[1:], None]):
        if below is not None:  # from above comes only the prior of the next level
            own = own.withColumns({"a": below * F.col("rate"), "b": below * (1 - F.col("rate"))})
        out = own if out is None else out.unionByName(own)
    return out, overall, weights[0]


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate) of pages(page_id, url); labels' doc_id is a page_id."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("failed")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(bad).where("failed is not null")
    scores, overall, weight = reputation(urls.join(known, "page_id").where("host <> ''").select("host", "failed"))
    doubt = beta_cdf(F.col("a"), F.col("b"), MAX_RATE)
    scores, of = table(scores.withColumn("doubt", doubt), "reputation"), urls
    far = urls.sparkSession.range(1).select(beta_cdf(F.lit(weight * overall), F.lit(weight * (1 - overall)), MAX_RATE)).first()[0]
    for level in LEVELS:
        own = scores.where(F.col("level") == level).select(F.col("key").alias(f"__{level}"), F.struct("rate", "doubt").alias(f"__of_{level}"))
        of = of.withColumn(f"__{level}", _keys(F.col("host"))[level]).join(small(own, 500_000), f"__{level}", "left")
    found = F.coalesce(*(f"__of_{level}" for level in reversed(LEVELS)))
    of = of.withColumn("rate", F.coalesce(found["rate"], F.lit(overall)))
    of = of.withColumn("doubt", F.when(F.col("host") == "", 1.0).otherwise(F.coalesce(found["doubt"], F.lit(far))))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("doubt") <= RISK, "block").otherwise("allow")
    return of.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "rate")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), read(spark, sf_dir, "labels")).drop("rate")


#: The beta posterior is summed over log-odds in steps of 0.01; a host without labels takes the nearest level's prior.
OP8_SQL = r"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM u),
w AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
k AS (SELECT *, regexp_replace(split_part(host, '@', -1), ':[0-9]*$', '') AS name FROM w),
l AS (SELECT *, list_filter(string_split(name, '.'), lambda x: x <> '') AS parts FROM k),
n AS (SELECT *, CASE WHEN len(parts) > 1 AND length(parts[-1]) = 2 AND list_contains(SECOND_LIST, parts[-2]) THEN 2 ELSE 1 END AS wide FROM l),
h AS (SELECT page_id, host, path,
  CASE WHEN regexp_matches(name, '^[0-9.]*$|^\[') OR len(parts) <= wide THEN name ELSE array_to_string(parts[greatest(len(parts) - wide + 1, 1):], '.') END AS suffix,
  CASE WHEN regexp_matches(name, '^[0-9.]*$|^\[') OR len(parts) <= wide THEN name ELSE array_to_string(parts[greatest(len(parts) - wide, 1):], '.') END AS domain FROM n),
known AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NULL AND quality IS NULL THEN NULL WHEN toxic IS NULL OR quality IS NULL THEN NULL ELSE 0 END) AS failed
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT suffix, domain, host, count(*) AS n, CAST(sum(failed) AS DOUBLE) AS failed FROM h JOIN known USING (page_id) WHERE failed IS NOT NULL AND host <> '' GROUP BY ALL),
o AS (SELECT coalesce(sum(failed) / sum(n), 0.0) AS overall FROM t),
s0 AS (SELECT suffix, sum(n) AS n, sum(failed) AS failed, overall AS prior FROM t, o GROUP BY suffix, overall),
m0 AS (SELECT WEIGHT AS weight FROM s0),
s1 AS (SELECT *, failed + weight * prior AS a, n - failed + weight * (1 - prior) AS b FROM s0, m0),
d0 AS (SELECT t.suffix, domain, sum(t.n) AS n, sum(t.failed) AS failed, any_value(a / (a + b)) AS prior FROM t JOIN s1 USING (suffix) GROUP BY t.suffix, domain),
m1 AS (SELECT WEIGHT AS weight FROM d0),
d1 AS (SELECT d0.*, failed + weight * prior AS a, n - failed + weight * (1 - prior) AS b FROM d0, m1),
h0 AS (SELECT t.suffix, t.domain, host, t.n, t.failed, a / (a + b) AS prior FROM t JOIN d1 USING (suffix, domain)),
m2 AS (SELECT WEIGHT AS weight FROM h0),
scores AS (
  SELECT 3 AS depth, host AS key, failed + weight * prior AS a, n - failed + weight * (1 - prior) AS b FROM h0, m2
  UNION ALL SELECT 2, domain, m2.weight * a / (a + b), m2.weight * b / (a + b) FROM d1, m2
  UNION ALL SELECT 1, suffix, m1.weight * a / (a + b), m1.weight * b / (a + b) FROM s1, m1
  UNION ALL SELECT 0, '', m0.weight * overall, m0.weight * (1 - overall) FROM o, m0),
doubts AS (SELECT depth, key, CASE WHEN a <= 0 THEN 1.0 WHEN b <= 0 THEN 0.0 ELSE
  list_sum(list_transform(range(0, 8000), lambda i: exp(lgamma(a + b) - lgamma(a) - lgamma(b) - a * ln(1 + exp(0.01 * (i + 0.5))) - b * ln(1 + exp(-0.01 * (i + 0.5)))))) * 0.01 END AS doubt FROM scores),
r AS (SELECT h.page_id, h.host, h.path, coalesce(x3.doubt, x2.doubt, x1.doubt, x0.doubt) AS doubt FROM h
  LEFT JOIN doubts x3 ON x3.depth = 3 AND x3.key = h.host LEFT JOIN doubts x2 ON x2.depth = 2 AND x2.key = h.domain
  LEFT JOIN doubts x1 ON x1.depth = 1 AND x1.key = h.suffix LEFT JOIN doubts x0 ON x0.depth = 0),
rules AS (SELECT * FROM (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')) AS q(rule, says)),
f AS (SELECT r.page_id, r.host, r.path, max_by(rule, length(rule)) AS rule, max_by(says, length(rule)) AS says FROM r JOIN rules
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY ALL)
SELECT r.page_id, r.host, r.path, f.rule, coalesce(says, CASE WHEN r.host <> '' AND doubt <= 0.05 THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN f USING (page_id, host, path)
""".replace(
    "WEIGHT",
    "coalesce(CASE WHEN sum(CASE WHEN prior * (1 - prior) > 0 THEN pow(failed / n - prior, 2) * n - prior * (1 - prior) END) > 0 AND sum((n - 1) * prior * (1 - prior)) > 0"
    " THEN least(1000.0, greatest(1.0, sum((n - 1) * prior * (1 - prior)) / sum(CASE WHEN prior * (1 - prior) > 0 THEN pow(failed / n - prior, 2) * n - prior * (1 - prior) END) - 1)) END, 1000.0)",
).replace("SECOND_LIST", "[" + ", ".join(f"'{x}'" for x in SECOND_LEVEL) + "]")
