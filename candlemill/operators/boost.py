"""The learned filter by histogram boosting: fits, scores, thresholds, votes and measures go over all samples.

A model is 300 small trees grown leaf by leaf over binned features, on four fifths of the past's samples and
seven tenths of the features a round. Every fold and seed whose past has at most MOST_TRAIN samples is fitted in a
task of its own. Longer pasts are fitted together, a job a level of their trees: samples stay where they are, tasks
add up gradients by bin, and leaf, and the driver sees the best cut of each leaf. Both ways give the same trees, as far
as sums in another order are the same: bins are shares of the whole past, and a round's samples are drawn by hash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.functions.edges import BINS, edges, past_edges, together
from candlemill.functions.quantile import at_shares
from candlemill.operators.regime import folds, numbered
from candlemill.sources.shared import shared_path, written

#: Fixed values of the fits: rounds, learning rate, leaves, least samples a leaf, shares of features and samples a round, L2.
ROUNDS, RATE, LEAVES, LEAST_LEAF, FEATURE_SHARE, SAMPLE_SHARE, L2 = 300, 0.03, 8, 40, 0.7, 0.8, 5.0
#: Samples of a past up to which one task fits it, samples of a block and blocks of a task beyond, and rounds between checkpoints of the scores.
MOST_TRAIN, BLOCK, TASK_BLOCKS, CHECKPOINT = 200_000, 65_536, 16, 25
NODE = ("feature", "threshold", "left", "right", "value", "gain")


def _sums(binned: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, at: np.ndarray | None = None, slots: int = 1) -> np.ndarray:
    """Sums of g, of h and counts of a leaf's rows by feature and bin, for each slot that `at` deals the rows to. Features are gone through one by one, each a column of binned that lies in one piece."""
    n = BINS + 1
    out = np.empty((slots, 3, len(columns), n))
    first = 0 if at is None else at * n
    for i, j in enumerate(columns):
        bins = binned[:, j][rows] + first if slots > 1 else binned[:, j][rows].astype(np.intp)
        for k, v in enumerate((g, h, None)):
            out[:, k, i] = np.bincount(bins, v, minlength=slots * n).reshape(slots, n)
    return out


def _cut(sums: np.ndarray, columns: np.ndarray, least: int):
    """(gain, feature, bin, g and h of both sides) of the best cut of a leaf's sums; the first of equals."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    whole = sums.sum(axis=2, keepdims=True)
    right = whole - left
    worth = lambda s: s[0] ** 2 / (s[1] + L2)
    gain = np.where((left[2] >= least) & (right[2] >= least), worth(left) + worth(right) - worth(whole), -np.inf)
    k = int(np.argmax(gain))
    i, b = divmod(k, gain.shape[1])
    return float(gain[i, b]), int(columns[i]), b, [(float(s[0, i, b]), float(s[1, i, b])) for s in (left, right)]


def _split(binned: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, least: int):
    """(gain, feature, bin) of the best cut of a leaf's rows."""
    return _cut(_sums(binned, rows, g[rows], h[rows], columns)[0], columns, least)[:3]


def _round(seed: int, k: int, m: int):
    """What round k draws: a number for its samples' hashes, and its features."""
    rng = np.random.default_rng([seed, k])
    salt = rng.integers(0, 1 << 64, dtype=np.uint64)
    return salt, np.sort(rng.permutation(m)[: max(1, int(np.ceil(m * FEATURE_SHARE)))])


def _drawn(place: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Which of the samples at these places of the past a round sees: a share of them, each told by its place alone, wherever it lies."""
    x = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(SAMPLE_SHARE * 2**64))


def _first(mean: float) -> float:
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left").astype(np.uint8) for j, c in enumerate(cuts)]).T


def fit(x: np.ndarray, y: np.ndarray, seed: int, rounds: int = ROUNDS, least: int = LEAST_LEAF) -> dict:
    """The first score and the trees, lists of NODE, of samples x (a row each) labelled y."""
    n, m = x.shape
    cuts = [edges(x[:, j]) for j in range(m)]
    binned, first, place = _binned(x, cuts), _first(float(y.mean())), np.arange(n)
    score, trees = np.full(n, first), []
    for k in range(rounds):
        salt, columns = _round(seed, k, m)
        bag = np.flatnonzero(_drawn(place, salt))
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        nodes = [[-1, 0.0, -1, -1, 0.0, 0.0]]
        leaves = {0: (bag, place, _split(binned, bag, g, h, columns, least))}
        while len(leaves) < LEAVES:
            at = max(leaves, key=lambda i: (leaves[i][2][0], -i))
            own, every, (gain, j, cut) = leaves[at]
            if gain <= 1e-12:
                break
            del leaves[at]
            more = len(leaves) + 2 < LEAVES  # the last cut's leaves are cut no further
            nodes[at][:4], nodes[at][5] = [j, float(cuts[j][cut]), len(nodes), len(nodes) + 1], gain
            for part in (True, False):
                below = [r[(binned[:, j][r] <= cut) == part] for r in (own, every)]
                leaves[len(nodes)] = (*below, _split(binned, below[0], g, h, columns, least) if more else None)
                nodes.append([-1, 0.0, -1, -1, 0.0, 0.0])
        for i, (own, every, _) in leaves.items():
            nodes[i][4] = float(-g[own].sum() / (h[own].sum() + L2) * RATE)
            score[every] += nodes[i][4]
        trees.append(nodes)
    return {"first": first, "trees": trees}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of samples x."""
    total, columns = np.full(len(x), model["first"]), np.ascontiguousarray(x.T)
    for nodes in model["trees"]:
        at = np.zeros(len(x), np.int32)
        for i, (feature, threshold, left, right, *_) in enumerate(nodes):  # a node comes before those below it
            if feature >= 0:
                np.copyto(at, np.where(columns[feature] <= threshold, np.int32(left), np.int32(right)), where=at == i)
        total += np.array([v[4] for v in nodes])[at]
    return 1 / (1 + np.exp(-total))


def _past(given: DataFrame, blocks: int) -> DataFrame:
    """given once for each fold `of` whose past or block it lies in, with test telling which; the last block is blocks - 1."""
    own = F.coalesce("fold", F.lit(-1))
    return given.withColumn("of", F.explode(F.sequence(F.greatest(own, F.lit(0)), F.lit(blocks - 1)))).withColumn("test", F.col("of") == own)


def _leaves(binned: np.ndarray, nodes: list, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The rows of each leaf of a tree whose nodes are [feature, bin, left, right, ...]."""
    parts, out = {0: rows}, []
    for i, v in enumerate(nodes):
        if v[0] < 0:
            out.append((i, parts[i]))
            continue
        low = binned[:, v[0]][parts[i]] <= v[1]
        parts[v[2]], parts[v[3]] = parts[i][low], parts[i][~low]
    return out


def _grow(nodes: list, leaves: dict, known: dict) -> list[int]:
    """Cuts the best leaf as long as the best cuts of the leaves below it are known: the leaves to look below, or none when the tree is done."""
    while len(leaves) < LEAVES:
        at = max(leaves, key=lambda i: (leaves[i][0], -i))
        gain, j, b, sides = leaves[at]
        if gain <= 1e-12:
            break
        more = len(leaves) + 1 < LEAVES
        if more and at not in known:
            return [i for i, v in leaves.items() if v[0] > 1e-12 and i not in known]
        del leaves[at]
        nodes[at][:4], nodes[at][5] = [j, b, len(nodes), len(nodes) + 1], gain
        for side in (0, 1):
            leaves[len(nodes)] = known[at][side] if more else None
            nodes.append([-1, 0, -1, -1, -sides[side][0] / (sides[side][1] + L2) * RATE, 0.0])
    return []


def _look(block: tuple, asked: dict, draws: dict) -> Iterator[tuple]:
    """A block's sums below the leaves that are asked for, by model: a slot a side of a leaf's best cut, or one for the root."""
    of, place, y, binned, score = block
    for (model_of, seed), (nodes, cuts) in asked.items():
        if model_of != of:
            continue
        salt, columns = draws[seed]
        rows, at = [], []
        for leaf, own in _leaves(binned, nodes, np.flatnonzero(_drawn(place, salt))):
            if cuts is None or leaf in cuts:
                rows.append(own)
                at.append(np.zeros(len(own), np.intp) if cuts is None else 2 * cuts[leaf][0] + (binned[:, cuts[leaf][1]][own] > cuts[leaf][2]))
        rows, at = np.concatenate(rows), np.concatenate(at)
        p = 1 / (1 + np.exp(-score[seed][rows]))
        yield (of, seed), _sums(binned, rows, p - y[rows], p * (1 - p), columns, at, 1 if cuts is None else 2 * len(cuts))


def _moved(block: tuple, trees: dict) -> tuple:
    """A block with its scores after a round's trees."""
    of, place, y, binned, score = block
    new = {seed: s.copy() for seed, s in score.items()}
    for (model_of, seed), nodes in trees.items():
        if model_of == of:
            for i, own in _leaves(binned, nodes, np.arange(len(y))):
                new[seed][own] += nodes[i][4]
    return of, place, y, binned, new


def _best_cuts(item: tuple, draws: dict, least: int) -> tuple:
    (of, seed), sums = item
    roots = None if len(sums) > 1 else tuple(float(s) for s in sums[0, :2, 0].sum(axis=1))
    return (of, seed), [_cut(s, draws[seed][1], least) for s in sums], roots


def fit_spread(blocks: RDD, firsts: dict[int, float], cuts: dict[int, list[np.ndarray]], seeds: tuple[int, ...], rounds: int = ROUNDS, least: int = LEAST_LEAF) -> dict[tuple, dict]:
    """{(of, seed): model} as fit() gives it, of blocks (of, place, y, binned, scores by seed) of each past `of`, which are persisted here.

    The leaves below which a tree may go on are looked at together, in all trees of a round, so a round takes about as many
    jobs as its trees have levels. Scores are carried from round to round in the blocks.
    """
    sc, keys = blocks.context, [(of, seed) for of in firsts for seed in seeds]
    models = {(of, seed): {"first": firsts[of], "trees": []} for of, seed in keys}
    m = len(next(iter(cuts.values())))
    data = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    for k in range(rounds):
        draws = {seed: _round(seed, k, m) for seed in seeds}
        trees = {key: ([[-1, 0, -1, -1, 0.0, 0.0]], {}, {}) for key in keys}
        asked, before = {key: (trees[key][0], None) for key in keys}, None
        if k:
            before, data = data, data.map(partial(_moved, trees=last)).persist(StorageLevel.MEMORY_AND_DISK)
            if k % CHECKPOINT == 0:
                data.checkpoint()
        while asked:
            added = data.flatMap(partial(_look, asked=asked, draws=draws)).reduceByKey(np.add, min(len(asked), sc.defaultParallelism))
            for key, found, root in added.map(partial(_best_cuts, draws=draws, least=least)).collect():
                nodes, leaves, known = trees[key]
                if asked[key][1] is None:
                    leaves[0], nodes[0][4] = found[0], -root[0] / (root[1] + L2) * RATE
                else:
                    known.update({i: (found[2 * n], found[2 * n + 1]) for i, (n, _, _) in asked[key][1].items()})
            wanted = {key: _grow(*trees[key]) for key in asked}
            asked = {key: (trees[key][0], {i: (n, *trees[key][1][i][1:3]) for n, i in enumerate(below)}) for key, below in wanted.items() if below}
            if before is not None:
                before.unpersist()
                before = None
        last = {key: nodes for key, (nodes, _, _) in trees.items()}
        for (of, seed), nodes in last.items():
            # values of nodes that were cut further are of no use
            models[of, seed]["trees"].append([[j, float(cuts[of][j][b]), left, right, 0.0, gain] if j >= 0 else [-1, 0.0, -1, -1, v, 0.0] for j, b, left, right, v, gain in nodes])
    data.unpersist()
    return models


def _fit_long(given: DataFrame, order: list[str], blocks: int, long: dict[int, tuple], seeds: tuple[int, ...], rounds: int, least: int) -> list[tuple]:
    """(of, seed, model) of the pasts of given(label, features, fold) that are too long for a task."""
    spark = given.sparkSession
    m = given.select(F.max(F.size("features"))).first()[0]
    names = [f"f{j}" for j in range(m)]
    given = given.select(F.coalesce("fold", F.lit(-1)).alias("fold"), "label", "features", *order).where(F.col("fold") < max(long))
    given = written(given, "past")  # gone through once for every few bits of the cuts
    # value by value: a whole array made plain would be made so anew for each of its values
    columns = given.select("fold", *(F.coalesce(F.nanvl(F.get("features", F.lit(j)), F.lit(0.0)), F.lit(0.0)).alias(c) for j, c in enumerate(names)))
    cuts = past_edges(columns, names, blocks, BINS, tuple(long))
    firsts = {of: _first(y / n) for of, (n, y) in long.items()}
    placed = numbered(given.withColumn("features", _plain("features")), [], order).select("fold", "i", "label", "features")
    total = sum(n for n, _ in long.values())
    tasks = max(spark.sparkContext.defaultParallelism, total // (BLOCK * TASK_BLOCKS))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in together(frames, BLOCK):
            yield from block(f)

    def block(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, fold, place, y = np.stack(f["features"]).astype(float), f["fold"].to_numpy(), f["i"].to_numpy(np.int64), f["label"].to_numpy(float)
        for of in long:
            own = fold < of
            if own.any():
                parts = (place[own], y[own], _binned(x[own], cuts[of]).T)  # a column of binned lies in one piece
                yield pd.DataFrame([(of, *(np.ascontiguousarray(v).tobytes() for v in parts))], columns=["of", "place", "y", "binned"])

    def unpack(r) -> tuple:
        y = np.frombuffer(r["y"])
        return r["of"], np.frombuffer(r["place"], np.int64), y, np.frombuffer(r["binned"], np.uint8).reshape(m, len(y)).T, {seed: np.full(len(y), firsts[r["of"]]) for seed in seeds}

    dealt = placed.repartition(tasks, "i").mapInPandas(deal, "of int, place binary, y binary, binned binary")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "boost"))
    return [(*key, json.dumps(model)) for key, model in fit_spread(dealt.rdd.map(unpack), firsts, cuts, seeds, rounds, least).items()]


def _plain(features: str):
    return F.transform(features, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))


def models(given: DataFrame, order: list[str], blocks: int, seeds: tuple[int, ...], rounds: int = ROUNDS, least: int = LEAST_LEAF) -> DataFrame:
    """(of, seed, model) of given(label, features, fold): one fit a fold and seed on all that lies before the fold; pasts of one class have none. Null features count 0."""
    train = _past(given.withColumn("features", _plain("features")), blocks).where(~F.col("test")).select("of", "label", "features", *order)
    sizes = {r["of"]: (r["n"], r["y"]) for r in train.groupBy("of").agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect()}
    long = {of: v for of, v in sorted(sizes.items()) if v[0] > MOST_TRAIN}
    train = train.where(~F.col("of").isin(list(long))) if long else train
    train = train.select("*", F.posexplode(F.array(*map(F.lit, seeds))).alias("k", "seed"))
    # a partition a fit, by number: small as they are, hashed ones would be put together and fitted one after the other
    train = train.repartitionById(blocks * len(seeds), (F.col("of") * len(seeds) + F.col("k")).cast("int")).drop("k")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, part in pd.concat([pd.DataFrame([], columns=["of", "seed"]), *frames]).groupby(["of", "seed"]):
            part = part.sort_values(order, kind="stable")
            y = part["label"].to_numpy(float)
            if 0 < y.sum() < len(y):
                model = fit(np.stack(part["features"]).astype(float), y, int(key[1]), rounds, least)
                yield pd.DataFrame([(*key, json.dumps(model))], columns=["of", "seed", "model"])

    schema = "of int, seed int, model string"
    fitted = train.mapInPandas(run, schema)
    long = {of: v for of, v in long.items() if 0 < v[1] < v[0]}
    if not long:
        return fitted
    return fitted.unionByName(given.sparkSession.createDataFrame(_fit_long(given, order, blocks, long, seeds, rounds, least), schema))


def walk_forward(samples: DataFrame, order: list[str], seeds: tuple[int, ...] = (0,), rounds: int = ROUNDS, least_leaf: int = LEAST_LEAF, **sizes) -> DataFrame:
    """samples(label, features array<double>, order) with of, seed, score and test: the score of each fold's model for the fold (test) and for its past.

    Folds are those of regime.folds. A fold's model has seen nothing of the fold or after it. As many models as
    folds times seeds reach the driver, of fixed size each. Null features count 0, samples without label go.
    """
    blocks = sizes.get("blocks", 4)
    given = folds(samples.where("label is not null"), [], order, **sizes)
    given = given.join(F.broadcast(given.agg(F.count("fold").alias("__folded"))), F.col("__folded") > 0).drop("__folded")
    known = {(r["of"], r["seed"]): json.loads(r["model"]) for r in models(given, order, blocks, seeds, rounds, least_leaf).collect()}
    shared = samples.sparkSession.sparkContext.broadcast(known)
    tasks = 3 * samples.sparkSession.sparkContext.defaultParallelism
    wide = _past(given.repartition(tasks, *order).withColumn("features", _plain("features")), blocks)  # scoring costs far more than its rows' bytes tell
    keep = [c for c in wide.columns if c != "features"]
    schema = wide.select(*keep).schema.add("seed", "integer").add("score", "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for of, own in f.groupby("of"):
                x = np.stack(own["features"]).astype(float)
                for seed in seeds:
                    if (model := shared.value.get((of, seed))) is not None:
                        yield own[keep].assign(seed=np.int32(seed), score=scores(model, x))

    return wide.mapInPandas(run, schema)


def thresholds(scored: DataFrame, keeps: tuple[float, ...]) -> DataFrame:
    """(of, seed, keep, threshold): the score that the best share keep of a fold's own past reaches."""
    cuts = at_shares(scored.where("not test"), ["of", "seed"], "score", {f"k{i}": 1 - k for i, k in enumerate(keeps)})
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("keep"), F.col(f"k{i}").alias("threshold")) for i, k in enumerate(keeps))))
    return cuts.select("of", "seed", long.alias("x")).select("of", "seed", "x.keep", "x.threshold")


def kept(scored: DataFrame, keeps: tuple[float, ...]) -> DataFrame:
    """Test rows that reach their fold's threshold, once a keep."""
    return scored.where("test").join(thresholds(scored, keeps), ["of", "seed"]).where("score >= threshold")


def selection(scored: DataFrame, order: list[str], keep: float, n_seeds: int) -> DataFrame:
    """(order, votes) of the samples that more than half of the seeds keep, out of sample."""
    return kept(scored, (keep,)).groupBy(*order).agg(F.count("*").alias("votes")).where(F.col("votes") > n_seeds / 2)


def importances(fitted: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(of, seed, feature, gain_pct) of models(): each feature's share of the splits' gain."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for of, seed, model in f.itertuples(index=False):
                gains = dict.fromkeys(names, 0.0)
                for nodes in json.loads(model)["trees"]:
                    for v in nodes:
                        if v[0] >= 0:
                            gains[names[v[0]]] += v[5]
                total = sum(gains.values()) or 1.0
                yield pd.DataFrame([(of, seed, k, g / total * 100) for k, g in gains.items()], columns=["of", "seed", "feature", "gain_pct"])

    return fitted.select("of", "seed", "model").mapInPandas(run, "of int, seed int, feature string, gain_pct double")
