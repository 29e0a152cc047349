from datetime import datetime, timedelta

import pytest

from candlemill.streaming.feed import stream_bars
from candlemill.streaming.upserts import UpsertLog

SCHEMA = "symbol string, start timestamp, c double"
T0 = datetime(2024, 1, 2, 4, 0)


def _batch(spark, rows):
    return spark.createDataFrame([(s, T0 + timedelta(minutes=m) if m is not None else None, c) for s, m, c in rows], SCHEMA)


def _live(log):
    return {(r.symbol, (r.start - T0).seconds // 60): r.c for r in log.read().collect()}


def test_merges_keep_the_latest_and_survive_a_crash(spark, tmp_path):
    log = UpsertLog(spark, str(tmp_path), SCHEMA)
    assert _live(log) == {} and log.merge() is None and log.vacuum() == []
    log.compact()
    want = {}
    for n in range(6):
        rows = [("A", n, float(n)), ("A", 0, 10.0 + n), ("B", n % 2, float(n)), ("A", 0, 5.0), (None, 1, 1.0), ("C", None, 1.0)]
        log.write(_batch(spark, rows), n)
        want |= {("A", n): float(n), ("A", 0): 10.0 + n, ("B", n % 2): float(n)}
        assert _live(log) == want
        if n == 2:
            log.compact()
            assert log.manifest()[1:] == (2, 0) and _live(log) == want
    log.write(_batch(spark, [("A", 5, 5.0), ("A", 0, 15.0), ("B", 1, 5.0)]), 5)  # a batch again
    assert _live(log) == want
    lost = log.merge()  # a crash before the manifest: the base that nothing names is never read
    assert lost and log.manifest()[1:] == (2, 0) and _live(log) == want
    log.write(_batch(spark, [("B", 9, 9.0)]), 6)
    want["B", 9] = 9.0
    assert _live(log) == want
    log.compact()
    assert log.manifest()[1:] == (6, 1) and _live(log) == want
    assert any(log.manifest()[0] in f for f in log.read().inputFiles()) and not any(lost[0] in f for f in log.read().inputFiles())
    assert "> 6)" in log.read()._jdf.queryExecution().toString()  # batches of the past are pruned
    assert log._log(log.manifest()[1]).count() == 0
    gone = log.vacuum()
    assert f"base/{lost[0]}" in gone and {"log/batch=0", "log/batch=2"} <= set(gone) and "log/batch=3" not in gone and _live(log) == want
    log.write(_batch(spark, [("A", 0, 1.0)]), 7)
    log.compact()
    assert any(x.startswith("manifest/") for x in log.vacuum(1)) and _live(log) == want | {("A", 0): 1.0}


@pytest.mark.parametrize("every", [0, 2])
def test_stream_of_bars_into_a_merged_table(spark, tmp_path, every):
    ticks = [(i, "A", T0 + timedelta(minutes=i), 100.0 + i % 7) for i in range(120)]
    schema = "tick_id long, symbol string, ts timestamp, price double"
    for k in range(4):
        spark.createDataFrame(ticks[max(0, 30 * k - 5) : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = UpsertLog(spark, str(tmp_path / "out"), "symbol string, start timestamp, o double, h double, l double, c double, v double", every=every)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_bars(feed).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(log.write).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r.start: (r.o, r.h, r.l, r.c, r.v) for r in log.read().collect()}
    assert got and (log.manifest()[0] is not None) == bool(every)
    for at, values in got.items():
        own = [p for _, _, t, p in ticks if at <= t < at + timedelta(minutes=15)]
        assert values == (own[0], max(own), min(own), own[-1], 15.0)
