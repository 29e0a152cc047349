from pyspark.sql import functions as F

from candlemill import registry
from candlemill.functions.tables import EVENTS, register
from candlemill.operators import setups
from candlemill.operators.backtest import backtest, passed
from candlemill.sources.testdata import bars
from tests.oracle import duck, spark_rows

SF, MIN = "/root/testdata/sf0.01", 60_000


def test_queries_match_their_sql(spark):
    for name in ("g17_filtered_replay", "c13_supertrend_sql"):
        columns, want = duck(SF, registry.oracle_sql()[name])
        assert spark_rows(registry.queries()[name](spark, SF)) == (columns, want) and want, name


def test_sweep_setup_of_sql_equals_the_grid(spark):
    register(spark)
    b = bars(spark, SF)
    setups.with_sessions(b.dropna(subset=["o", "h", "l", "c"]), 2, 4).createOrReplaceTempView("sessions")
    got = spark.sql("SELECT * FROM sweep_setup(TABLE(sessions) PARTITION BY (symbol, day) ORDER BY ts_ms)").collect()
    names = [c.split()[0] for c in EVENTS.split(", ")]
    want = setups.sweep_events(b, setups.variants(spark, {"base": {}}), least_bars=4).select(names).collect()
    assert want and sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_what_a_hook_turns_away_takes_no_slot(spark):
    schema = "symbol string, ts_ms long, action string, confidence double, entry double, target double, stop double, vix double, score double"
    rows = [("A", 0, "BUY", 80.0, 100.0, 105.0, 95.0, 30.0, 0.9), ("A", 10 * MIN, "BUY", 80.0, 101.0, 106.0, 96.0, 12.0, 0.9), ("A", 25 * MIN, "BUY", 80.0, 102.0, 107.0, 97.0, None, 0.9), ("A", 50 * MIN, "SELL", 40.0, 100.0, 95.0, 105.0, 12.0, 0.1)]
    readings = spark.createDataFrame(rows, schema)
    price = spark.createDataFrame([("A", k * 5 * MIN, 106.5, 99.0, 104.0) for k in range(20)], "symbol string, ts_ms long, h double, l double, c double")
    first = lambda **hooks: [(r.first_ms // MIN, r.action, r.status) for r in backtest(readings, price, **hooks).orderBy("first_ms").collect()]
    assert first() == [(0, "BUY", "target"), (25, "BUY", "expired"), (50, "SELL", "stop")]
    assert first(volatility=F.col("vix"), gate=18.0) == [(10, "BUY", "target"), (50, "SELL", "stop")]  # the first no longer holds the slot; null is no
    assert first(signal_filter=F.col("action") == "BUY", score=F.col("score"), least_score=0.5, least_confidence=60.0) == [(0, "BUY", "target"), (25, "BUY", "expired")]
    assert passed(readings, volatility=F.col("vix"), score=F.col("score")).count() == 4  # no bound, no hook
