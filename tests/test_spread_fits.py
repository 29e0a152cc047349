import json

import numpy as np

from candlemill.operators import boost, regime

ORDER = ["ts_ms", "symbol"]


def _samples(spark, x, y):
    rows = [(k, "s", [float(v) for v in r], int(t), float(2 * t - 1)) for k, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "ts_ms long, symbol string, features array<double>, label int, pts double")


def _data(n):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n).round(1), rng.integers(0, 5, n), rng.exponential(size=n) ** 4, np.full(n, 3.0)])
    return x, ((x[:, 0] > 0.2) ^ (x[:, 2] == 3) ^ (rng.random(n) < 0.15)).astype(int)


def test_long_pasts_are_fitted_on_every_sample(spark, monkeypatch):
    """A past of more than MOST_TRAIN samples was thinned to that; its trees are now those of one fit over all of it."""
    x, y = _data(1500)
    given = regime.folds(_samples(spark, x, y), [], ORDER, least=300).repartition(5)
    monkeypatch.setattr(boost, "MOST_TRAIN", 700)
    monkeypatch.setattr(boost, "BLOCK", 150)
    monkeypatch.setattr(boost, "CHECKPOINT", 4)
    got = {(r["of"], r["seed"]): json.loads(r["model"]) for r in boost.models(given, ORDER, 4, (0, 7), 10, 20).collect()}
    assert set(got) == {(of, seed) for of in range(4) for seed in (0, 7)}
    for (of, seed), model in got.items():
        cut = 300 + 300 * of
        want = boost.fit(x[:cut], y[:cut], seed, 10, 20)
        assert abs(model["first"] - want["first"]) < 1e-12 and len(model["trees"]) == 10
        for a, b in zip(model["trees"], want["trees"]):
            assert [v[0] for v in a] == [v[0] for v in b] and [v[2:4] for v in a] == [v[2:4] for v in b]
            assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_samples_of_a_round_are_a_share_and_differ(spark):
    place = np.arange(50_000)
    a, b = (boost._drawn(place, boost._round(seed, k, 5)[0]) for seed, k in ((0, 0), (0, 1)))
    assert abs(a.mean() - boost.SAMPLE_SHARE) < 0.01 and abs((a & b).mean() - boost.SAMPLE_SHARE**2) < 0.01
    assert np.array_equal(boost._drawn(place[1000:], boost._round(0, 0, 5)[0]), a[1000:])


def test_long_pasts_of_one_class_and_lone_leaves(spark, monkeypatch):
    monkeypatch.setattr(boost, "MOST_TRAIN", 100)
    x, _ = _data(600)
    given = regime.folds(_samples(spark, x, np.ones(600)), [], ORDER)
    assert boost.models(given, ORDER, 4, (0,), 2).count() == 0
    # no leaf may have fewer samples than there are: trees of one leaf, as fit() gives
    y = np.arange(600) % 2
    own = {r["of"]: json.loads(r["model"]) for r in boost.models(regime.folds(_samples(spark, x, y), [], ORDER), ORDER, 4, (0,), 2, 5000).collect()}
    for of, model in own.items():
        want = boost.fit(x[: 400 + 50 * of], y[: 400 + 50 * of], 0, 2, 5000)
        assert np.allclose(model["trees"], want["trees"], atol=1e-12) and len(model["trees"][0]) == 1
    assert sorted(own) == [0, 1, 2, 3]
