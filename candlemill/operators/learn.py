"""The learned filter: expanding walk-forward fits of boosted trees, their scores and importances, and stored datasets.

Trees see a sample's binned features and label alone, so samples of equal bins and label are one cell with a
count. One job counts all samples by cell; a fit goes over the cells, which do not grow with the samples once all
bins have met, in a task of its own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.functions.edges import past_edges, together
from candlemill.operators import boost
from candlemill.operators.regime import folds
from candlemill.sources.shared import written

#: Costs a dataset may be stored with, in points a trade.
MOST_COST = 200.0
#: Fixed values of the fits: depth, step of the trees after the first, least samples a leaf, shares of samples a tree and of features a node.
DEPTH, STEP, LEAST_LEAF, SAMPLE_SHARE, FEATURE_SHARE = 3, 0.1, 40, 0.8, 0.7
#: Values or shares of values that a feature's bins hold, and samples that a task puts together before it hands on counts.
BINS, AT_ONCE = 32, 1_000_000


def _best(bins: np.ndarray, rows: np.ndarray, w: np.ndarray, s: np.ndarray, columns: np.ndarray, width: int):
    """(gain, feature, bin, sums of the left side, sums of both) of the cut that takes most off the squared error of cells' targets; the first of equals."""
    own = [(np.bincount(bins[rows, j], w[rows], width), np.bincount(bins[rows, j], s[rows], width)) for j in columns]
    n, total = (np.array(x) for x in zip(*own))
    whole = n[0].sum(), total[0].sum()
    ln, ls = np.cumsum(n, axis=1)[:, :-1], np.cumsum(total, axis=1)[:, :-1]
    rn, rs = whole[0] - ln, whole[1] - ls
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((ln >= LEAST_LEAF) & (rn >= LEAST_LEAF), ls**2 / ln + rs**2 / rn - whole[1] ** 2 / whole[0], -np.inf)
    k = int(np.argmax(gain))
    return float(gain.flat[k]), int(columns[k // (width - 1)]), k % (width - 1), whole


def fit_cells(bins: np.ndarray, cuts: list[np.ndarray], n0: np.ndarray, n1: np.ndarray, seed: int, rounds: int = 8) -> dict:
    """A model as boost.fit's of n0 samples labelled 0 and n1 labelled 1 in each cell, a row of bins: gradient boosting with log loss as MLlib's GBTClassifier has it.

    A tree sees each sample with SAMPLE_SHARE, which for a cell's equal samples is a binomial draw of its count.
    """
    n, m = bins.shape
    width = max(len(c) for c in cuts) + 1
    margin, trees = np.zeros(n), []
    for k in range(rounds):
        rng = np.random.default_rng([seed, k])
        b0, b1 = rng.binomial(n0, SAMPLE_SHARE), rng.binomial(n1, SAMPLE_SHARE)
        up, down = (1.0, -1.0) if k == 0 else (4 / (1 + np.exp(2 * margin)), -4 / (1 + np.exp(-2 * margin)))
        w, s = (b0 + b1).astype(float), b1 * up + b0 * down
        nodes, level, step = [[-1, 0.0, -1, -1, 0.0, 0.0]], [(0, np.arange(n))], 1.0 if k == 0 else STEP
        for depth in range(DEPTH + 1):
            below = []
            for i, rows in level:
                columns = np.sort(rng.permutation(m)[: math.ceil(m * FEATURE_SHARE)])
                gain, j, cut, (count, total) = _best(bins, rows, w, s, columns, width) if width > 1 else (0.0, 0, 0, (w[rows].sum(), s[rows].sum()))
                if depth < DEPTH and gain > 1e-12:
                    nodes[i] = [j, float(cuts[j][cut]), len(nodes), len(nodes) + 1, 0.0, gain]
                    for side in (True, False):
                        below.append((len(nodes), rows[(bins[rows, j] <= cut) == side]))
                        nodes.append([-1, 0.0, -1, -1, 0.0, 0.0])
                else:
                    value = step * total / count if count else 0.0
                    margin[rows] += value
                    nodes[i][4] = float(2 * value)  # boost.scores takes log odds, twice the margin
            level = below
        trees.append(nodes)
    return {"first": 0.0, "trees": trees}


def cells(given: DataFrame, features: list[str], cuts: dict[int, list[np.ndarray]]) -> DataFrame:
    """(of, cell, n0, n1): the samples of given(fold, label, features) before each fold, counted by the bins of its cuts; cell numbers the bins, the last feature's fastest."""
    many = {of: [len(c) + 1 for c in own] for of, own in cuts.items()}
    if any(math.prod(x) >= 1 << 62 for x in many.values()):
        raise ValueError("too many features for cells of bins")

    def counted(of: int, held: list) -> pd.DataFrame:
        cell, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        label = np.concatenate([h[1] for h in held])
        return pd.DataFrame({"of": np.int32(of), "cell": cell, "n0": np.bincount(at, label == 0, len(cell)).astype(np.int64), "n1": np.bincount(at, label == 1, len(cell)).astype(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {of: [] for of in cuts}
        for f in together(frames):
            x, fold, label = f[features].to_numpy(float), f["fold"].to_numpy(), f["label"].to_numpy()
            for of, own in cuts.items():
                past = fold < of
                if past.any():
                    code = np.zeros(int(past.sum()), np.int64)
                    for j, c in enumerate(own):
                        code = code * many[of][j] + np.searchsorted(c, x[past, j], side="left")
                    held[of].append((code, label[past]))
                    if sum(len(h[0]) for h in held[of]) >= AT_ONCE:
                        yield counted(of, held[of])
                        held[of] = []
        yield from (counted(of, h) for of, h in held.items() if h)

    return given.select("fold", "label", *features).mapInPandas(run, "of int, cell long, n0 long, n1 long").groupBy("of", "cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _plain(samples: DataFrame, features: list[str]) -> DataFrame:
    return samples.where("label is not null").withColumn("label", F.col("label").cast("int")).fillna(0.0, subset=features)


def models(given: DataFrame, features: list[str], blocks: int, seeds: tuple[int, ...], rounds: int = 8) -> DataFrame:
    """(of, seed, model) of given(label, features, fold), fold -1 before the first: a fit a fold and seed on all that lies before the fold; pasts of one class have none.

    Missing features must be 0 already. A task holds the cells of one past: at most as many as its samples, and as its features' bins meet in.
    """
    past = given.where(F.col("fold") < blocks - 1)
    cuts = past_edges(past, features, blocks, BINS)
    own = cells(past, features, cuts).select("*", F.posexplode(F.array(*map(F.lit, seeds))).alias("k", "seed"))
    own = own.repartitionById(blocks * len(seeds), (F.col("of") * len(seeds) + F.col("k")).cast("int")).drop("k")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (of, seed), part in pd.concat([pd.DataFrame([], columns=["of", "seed"]), *frames]).groupby(["of", "seed"]):
            part = part.sort_values("cell")
            n0, n1, code = (part[c].to_numpy(np.int64) for c in ("n0", "n1", "cell"))
            if n0.sum() and n1.sum():
                bins = np.zeros((len(code), len(features)), np.intp)
                for j in reversed(range(len(features))):
                    code, bins[:, j] = np.divmod(code, len(cuts[of][j]) + 1)
                yield pd.DataFrame([(of, seed, json.dumps(fit_cells(bins, cuts[of], n0, n1, int(seed), rounds)))], columns=["of", "seed", "model"])

    return own.mapInPandas(run, "of int, seed int, model string")


def walk_forward(samples: DataFrame, features: list[str], order: list[str], seeds: tuple[int, ...] = (0,), rounds: int = 8, **sizes) -> DataFrame:
    """Rows of samples(label, features) that lie in a fold, once a seed, with the score of a model that saw only what came before.

    Folds are those of regime.folds over all samples with a label; a fold whose past has one class only is left out. Missing features
    count 0. Samples are written once with their folds; models, of fixed size each, reach the driver.
    """
    given = written(folds(_plain(samples, features), [], order, **sizes), "folded")
    last = given.agg(F.max("fold").alias("last")).first()["last"]
    blocks = 0 if last is None else last + 1
    fitted = models(given.withColumn("fold", F.coalesce("fold", F.lit(-1))), features, blocks, seeds, rounds).collect() if blocks else []
    known = given.sparkSession.sparkContext.broadcast({(r["of"], r["seed"]): json.loads(r["model"]) for r in fitted})

    @F.pandas_udf("double")
    def score(fold: pd.Series, seed: pd.Series, *columns: pd.Series) -> pd.Series:
        x, out = np.stack([c.to_numpy(float) for c in columns], axis=1), np.zeros(len(fold))
        for key in set(zip(fold, seed)):
            own = (fold == key[0]).to_numpy() & (seed == key[1]).to_numpy()
            out[own] = boost.scores(known.value[key], x[own])
        return pd.Series(out)

    rows = given.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    fits = F.lit(False)
    for of, seed in sorted(known.value):
        fits = fits | ((F.col("fold") == of) & (F.col("seed") == seed))
    return rows.where(fits).withColumn("score", score("fold", "seed", *features))


def importances(samples: DataFrame, features: list[str], seed: int) -> DataFrame:
    """(feature, gain_pct) of a model of all samples, the largest first; as many rows as features."""
    fitted = models(_plain(samples, features).withColumn("fold", F.lit(-1)), features, 1, (seed,))
    return boost.importances(fitted, tuple(features)).select("feature", "gain_pct").orderBy(F.desc("gain_pct"), "feature")


def gated(samples: DataFrame, gate: float, least: int = 500) -> DataFrame:
    """Samples on days whose volatility does not exceed gate, or none of them where there are fewer than least."""
    calm = samples.where(F.col("vix") <= gate)
    enough = calm.agg((F.count("*") >= least).alias("enough"))
    return calm.crossJoin(F.broadcast(enough)).where("enough").drop("enough")


def save_dataset(samples: DataFrame, path: str, cost: float) -> None:
    """Samples as Parquet with the cost they were labelled at beside them."""
    if not 0 <= cost < MOST_COST:
        raise ValueError(f"cost {cost} is not in [0, {MOST_COST})")
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    samples.sparkSession.createDataFrame([(float(cost),)], "cost double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    cost = spark.read.parquet(f"{path}/meta").first()[0]
    if not 0 <= cost < MOST_COST:
        raise ValueError(f"stored cost {cost} is not in [0, {MOST_COST})")
    return spark.read.parquet(f"{path}/samples"), cost
