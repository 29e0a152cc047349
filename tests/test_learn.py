import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.functions.edges import edges, past_edges
from candlemill.operators import boost, learn, regime


@pytest.mark.parametrize("few", [0, 32])
def test_cuts_of_the_past_are_those_of_its_values(spark, monkeypatch, few):
    monkeypatch.setattr("candlemill.functions.edges.FEW_COLUMNS", few)
    rng = np.random.default_rng(4)
    rows = [(int(k), float(a), float(b), float(c)) for k, a, b, c in zip(rng.integers(-1, 3, 6000), rng.normal(size=6000) ** 3, rng.integers(-4, 5, 6000), rng.choice([-1e300, -0.0, 0.0, 5e-324, 7.25], 6000))]
    given = spark.createDataFrame(rows, "fold int, a double, b double, c double")
    for parts in (1, 7):
        got = past_edges(given.repartition(parts), ["a", "b", "c"], 3, 20)
        for of in range(3):
            for j in range(3):
                assert np.array_equal(got[of][j], edges(np.array([r[j + 1] for r in rows if r[0] < of]) + 0.0, 20))


def test_folds_equal_the_places_in_order(spark):
    """Only rows of values in which a fold begins are put in order; nulls come first, and a value may hold several folds."""
    s = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") % 23).alias("day"), (F.col("id") % 2).alias("g"))
    s = s.unionByName(spark.range(5000, 5090).select(F.col("id").alias("k"), F.lit(3).cast("long").alias("day"), F.lit(None).cast("long").alias("g")))
    for by in ([], ["g"]):
        for least in (1, 130, 400):
            n = regime.numbered(s, by, ["day", "k"])
            block = F.floor((F.col("n") - least) / 4)
            want = n.withColumn("fold", F.when((block >= 20) & (F.col("i") >= least), F.least(F.floor((F.col("i") - least) / block), F.lit(3)).cast("int")))
            got = regime.folds(s, by, ["day", "k"], least=least)
            assert got.columns == ["k", "day", "g", "fold"]
            assert sorted(got.collect(), key=str) == sorted(want.select(got.columns).collect(), key=str)


def test_cells_count_every_sample(spark, monkeypatch):
    monkeypatch.setattr(learn, "AT_ONCE", 50)
    given = spark.range(4000).select((F.col("id") % 3 - 1).cast("int").alias("fold"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 5).cast("double").alias("x"), F.rand(1).alias("y")).repartition(3)
    cuts = {of: own for of, own in past_edges(given, ["x", "y"], 2, 4).items()}
    got = {of: (n0, n1, cells) for of, n0, n1, cells in learn.cells(given, ["x", "y"], cuts).groupBy("of").agg(F.sum("n0"), F.sum("n1"), F.count("*")).collect()}
    pasts = {of: given.where(F.col("fold") < of).groupBy().agg(F.sum(1 - F.col("label")), F.sum("label")).first() for of in (0, 1)}
    assert {of: v[:2] for of, v in got.items()} == {of: tuple(v) for of, v in pasts.items()}
    assert all(v[2] <= 5 * 5 for v in got.values())


def test_a_tree_of_cells_is_one_of_their_samples(monkeypatch):
    """Without draws the first tree's first cut is the best of all cuts of the single samples, and its values are means of their labels."""
    monkeypatch.setattr(learn, "SAMPLE_SHARE", 1.0)
    monkeypatch.setattr(learn, "FEATURE_SHARE", 1.0)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(900, 3)).astype(float)
    y = np.where(rng.random(900) < 0.2, rng.integers(0, 2, 900), (x[:, 1] > 2) ^ (x[:, 0] == 4))
    cuts = [edges(x[:, j], 32) for j in range(3)]
    cell, at = np.unique(x, axis=0, return_inverse=True)
    n1 = np.bincount(at.ravel(), y, len(cell)).astype(np.int64)
    n0 = np.bincount(at.ravel(), 1 - y, len(cell)).astype(np.int64)
    model = learn.fit_cells(cell.astype(np.intp), cuts, n0, n1, 0, 2)
    target = 2.0 * y - 1
    spread = lambda r: target[r].sum() ** 2 / len(target[r]) if r.any() else 0.0
    gains = {(j, float(c)): spread(x[:, j] <= c) + spread(x[:, j] > c) - spread(np.ones(900, bool)) for j in range(3) for c in cuts[j] if min((x[:, j] <= c).sum(), (x[:, j] > c).sum()) >= 40}
    top = model["trees"][0][0]
    assert math.isclose(top[5], max(gains.values())) and math.isclose(gains[top[0], top[1]], top[5])
    p = boost.scores({"first": 0.0, "trees": model["trees"][:1]}, x)
    for v in np.unique(p):
        assert math.isclose(np.log(v / (1 - v)) / 2, target[p == v].mean(), abs_tol=1e-9)
    margin = np.log(p / (1 - p)) / 2  # the second tree moves each of its leaves by a tenth of the mean of what is left to learn
    moved = np.log((q := boost.scores(model, x)) / (1 - q)) / 2 - margin
    left = 2 * target * 2 / (1 + np.exp(2 * target * margin))
    at = np.array([next(i for i in _way(model["trees"][1], r)) for r in x])
    for i in np.unique(at):
        assert math.isclose(moved[at == i][0], 0.1 * left[at == i].mean(), abs_tol=1e-9)


def _way(nodes, row):
    i = 0
    while nodes[i][0] >= 0:
        i = nodes[i][2] if row[nodes[i][0]] <= nodes[i][1] else nodes[i][3]
    yield i


def test_scores_hang_on_the_past_alone_and_on_no_partitions(spark):
    s = spark.range(2000).select(F.col("id").alias("at"), F.round(F.rand(3), 3).alias("x"), F.when(F.rand(4) < 0.1, None).otherwise(F.rand(5)).alias("y")).withColumn("label", F.when(F.col("x") > 0.6, 1).otherwise(0))
    told = lambda df, **kw: {(r["at"], r["seed"]): r["score"] for r in learn.walk_forward(df, ["x", "y"], ["at"], (0, 1), **kw).collect()}
    s = s.cache()
    a, b = told(s), told(s.repartition(9, "x"))
    assert a == b and len(a) == 2 * 1600
    later = s.withColumn("label", F.when(F.col("at") >= 1600, 1 - F.col("label")).otherwise(F.col("label"))).withColumn("y", F.when(F.col("at") >= 1600, 1e9).otherwise(F.col("y")))
    c = told(later)
    assert all(c[k] == v for k, v in a.items() if k[0] < 1600)


def test_no_fit_holds_a_sample_a_row(spark):
    """Fits used to go over all samples once a level of every tree; they go over counts, which stay as samples are repeated."""
    one = spark.range(3000).select(F.lit(-1).alias("fold"), (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    many = one.crossJoin(spark.range(20)).drop("id")
    n = [learn.cells(df, ["x"], past_edges(df, ["x"], 1, learn.BINS)).agg(F.count("*"), F.sum(F.col("n0") + F.col("n1"))).first() for df in (one, many)]
    assert n[0][0] == n[1][0] <= learn.BINS + 1 and (n[0][1], n[1][1]) == (3000, 60000)
