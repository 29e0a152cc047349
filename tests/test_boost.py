import numpy as np
from pyspark.sql import functions as F

from candlemill.operators import boost, regime


def _data(n, rng, flip=0.0):
    x = rng.normal(size=(n, 6)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(int)
    return x, np.where(rng.random(n) < flip, 1 - y, y)


def _samples(spark, x, y):
    rows = [(k, "s", [None if j == 5 and k % 9 == 0 else float(v) for j, v in enumerate(r)], int(t), float(2 * t - 1)) for k, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "ts_ms long, symbol string, features array<double>, label int, pts double")


def test_trees_learn_a_rule_and_nothing_from_noise():
    rng = np.random.default_rng(1)
    x, y = _data(1500, rng, 0.1)
    p = boost.scores(boost.fit(x[:1000], y[:1000], 7, rounds=80), x[1000:])
    q = boost.scores(boost.fit(x[:1000], rng.integers(0, 2, 1000), 7, rounds=80), x[1000:])
    auc = lambda s, t: np.mean([(a > b) + (a == b) / 2 for a in s[t == 1] for b in s[t == 0]])
    assert auc(p, y[1000:]) > 0.8 and 0.4 < auc(q, y[1000:]) < 0.6
    again = boost.fit(x[:1000], y[:1000], 7, rounds=5)
    assert again == boost.fit(x[:1000], y[:1000], 7, rounds=5) != boost.fit(x[:1000], y[:1000], 8, rounds=5)


def test_the_best_cut_is_the_best_of_all():
    rng = np.random.default_rng(3)
    x, y = _data(300, rng)
    cuts = [boost.edges(x[:, j]) for j in range(6)]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    g, h, rows = rng.normal(size=300), rng.random(300), np.arange(0, 300, 2)
    worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + boost.L2)
    best = max(worth(a) + worth(b) - worth(rows) for j in range(6) for c in range(len(cuts[j])) if min(len(a := rows[binned[rows, j] <= c]), len(b := rows[binned[rows, j] > c])) >= 10)
    gain, j, cut = boost._split(binned, rows, g, h, np.arange(6), 10)
    low = binned[rows, j] <= cut
    assert abs(gain - best) < 1e-9 and abs(worth(rows[low]) + worth(rows[~low]) - worth(rows) - gain) < 1e-9


def test_folds_see_their_past_alone(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = _data(700, rng, 0.15)
    got = boost.walk_forward(_samples(spark, x, y), ["ts_ms", "symbol"], (0, 1), rounds=15, least=300).collect()
    score = {(r.of, r.seed, r.ts_ms): r.score for r in got}
    assert {(r.of, r.test) for r in got} == {(k, t) for k in range(4) for t in (True, False)} and len(got) == 2 * sum(400 + 100 * k for k in range(4))
    x[np.arange(0, 700, 9), 5] = 0.0
    for of in range(4):
        for seed in (0, 1):
            cut = 300 + 100 * of
            want = boost.scores(boost.fit(x[:cut], y[:cut], seed, rounds=15), x[: cut + 100])
            assert np.allclose([score[of, seed, k] for k in range(cut + 100)], want)
    later = y.copy()
    later[500:] = 1 - later[500:]  # other outcomes later change no score before
    other = {(r.of, r.seed, r.ts_ms): r.score for r in boost.walk_forward(_samples(spark, x, later), ["ts_ms", "symbol"], (0,), rounds=15, least=300).collect()}
    assert all(abs(v - score[k]) < 1e-12 for k, v in other.items() if k[0] <= 2) and any(abs(v - score[k]) > 1e-6 for k, v in other.items() if k[0] == 3)
    monkeypatch.setattr(boost, "MOST_TRAIN", 200)
    few = boost.models(regime.folds(_samples(spark, x, y), [], ["ts_ms", "symbol"], least=300), ["ts_ms", "symbol"], 4, (0,), 3, 20)
    assert few.count() == 4 and boost.importances(few, tuple("abcdef")).groupBy("of").agg(F.round(F.sum("gain_pct"), 6).alias("s")).select("s").distinct().collect() == [(100.0,)]


def test_thresholds_and_votes(spark):
    rows = [(0, s, k < 10, float(k if k < 10 else (k * 7 + s) % 20), k) for s in (0, 1, 2) for k in range(30)]
    scored = spark.createDataFrame([(o, s, not past, v, k) for o, s, past, v, k in rows], "of int, seed int, test boolean, score double, ts_ms long")
    cut = {(r.seed, r.keep): r.threshold for r in boost.thresholds(scored, (0.5, 0.1)).collect()}
    assert set(cut.values()) == {4.0, 8.0}
    kept = {(s, k) for o, s, past, v, k in rows if not past and v >= 4.0}
    want = {k: n for k in range(10, 30) if (n := sum((s, k) in kept for s in (0, 1, 2))) > 1.5}
    assert {r.ts_ms: r.votes for r in boost.selection(scored, ["ts_ms"], 0.5, 3).collect()} == want


def test_too_few_samples_give_nothing(spark):
    rng = np.random.default_rng(2)
    assert boost.walk_forward(_samples(spark, *_data(30, rng)), ["ts_ms", "symbol"]).count() == 0
    x, _ = _data(500, rng)
    assert boost.walk_forward(_samples(spark, x, np.ones(500)), ["ts_ms", "symbol"], rounds=2).count() == 0


def test_each_fit_has_a_task_of_its_own(spark):
    """Training rows are few bytes and many seconds: fits that share a task run one after the other."""
    given = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"), F.array(F.rand(1), F.rand(2)).alias("features"), F.floor(F.col("id") / 100).cast("int").alias("fold"))
    fitted = boost.models(given, ["id"], 4, (0, 1, 2), rounds=2).withColumn("task", F.spark_partition_id()).collect()
    assert {(r["of"], r["seed"]) for r in fitted} == {(of, seed) for of in (1, 2, 3) for seed in (0, 1, 2)}
    assert len({r["task"] for r in fitted}) == len(fitted) == 9
