import random

import pytest

from candlemill import registry
from candlemill.functions.scan import trailing, trailing_line
from tests.oracle import duck, spark_rows


def _fold(x, p):
    y = [x[0]]
    for v in x[1:]:
        y.append(y[-1] + (v - y[-1]) * 2 / (p + 1))
    return y


def test_windows_against_folds(spark):
    rng = random.Random(4)
    series = {s: [100 + rng.gauss(0, 5) for _ in range(n)] for s, n in (("A", 700), ("B", 30), ("C", 1))}
    rows = [(s, 60 * k, v, "k", 1.0) for s, x in series.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, c double, key string, line0 double")
    for bars in (2, 40, 375):
        got = {(r.symbol, r.ts_ms // 60): r.e for r in trailing(df, "c", 20, bars, "e").collect()}
        lines = {(r.symbol, r.ts_ms // 60): (r.line, r.signal) for r in trailing_line(df, "c", 12, 26, 9, bars).collect()}
        assert len(got) == len(lines) == len(rows)
        for s, x in series.items():
            for k in range(0, len(x), 7):
                own = x[max(0, k - bars + 1) : k + 1]
                assert abs(got[s, k] - _fold(own, 20)[-1]) < 1e-9
                line = [a - b for a, b in zip(_fold(own, 12), _fold(own, 26))]
                assert abs(lines[s, k][0] - line[-1]) < 1e-9 and abs(lines[s, k][1] - _fold(line, 9)[-1]) < 1e-9


@pytest.mark.parametrize("name", ["c1_trailing_ema", "c3_trailing_macd"])
def test_queries_at_a_larger_size(spark, name):
    columns, want = duck("/root/testdata/sf0.01", registry.oracle_sql()[name])
    assert spark_rows(registry.queries()[name](spark, "/root/testdata/sf0.01")) == (columns, want)
