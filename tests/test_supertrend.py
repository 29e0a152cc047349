import random

import numpy as np
import pytest

from candlemill import registry
from candlemill.operators import replay
from candlemill.operators.supertrend import Pieces, supertrend
from tests.oracle import duck, spark_rows


def test_maps_put_together_equal_steps():
    rng = np.random.default_rng(5)
    for _ in range(200):
        steps = rng.integers(0, 12, (rng.integers(1, 15), 2)).astype(float)
        p = Pieces()
        for close, top in steps:
            p.then(close, top)
        for u in np.r_[np.arange(-1, 14), rng.random(5) * 12]:
            v = u
            for close, top in steps:
                v = top if close > v else min(top, v)
            assert p.of(u) == v
        assert len(p.at) <= 2 * len(steps) + 1


def test_chunks_equal_the_walk(spark):
    rng = random.Random(6)
    rows = []
    for s, n in (("A", 900), ("B", 60), ("C", 11), ("D", 10), ("E", 1)):
        c = 100.0
        for k in range(n):
            c += rng.gauss(0, 1) + (3 if k % 97 == 0 else -3 if k % 61 == 0 else 0)
            rows.append((s, k * 900_000 + (k // 40) * 40_000_000, c + rng.random(), c - rng.random(), c, "x"))
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, h double, l double, c double, chunk string")
    want = {(r.symbol, r.ts_ms): (r.value, r.rising) for r in replay.supertrend(df).collect()}
    assert len({v[1] for v in want.values()}) == 2
    for chunk_ms in (900_000, 10_000_000, 1 << 40):
        got = {(r.symbol, r.ts_ms): (r.value, r.rising) for r in supertrend(df, chunk_ms=chunk_ms).collect()}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want), chunk_ms
    assert supertrend(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_its_sql(spark, sf):
    columns, want = duck(f"/root/testdata/{sf}", registry.oracle_sql()["c13_supertrend"])
    assert spark_rows(registry.queries()["c13_supertrend"](spark, f"/root/testdata/{sf}")) == (columns, want)
