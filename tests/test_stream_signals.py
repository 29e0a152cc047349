from candlemill.operators.signals import merge_signals
from candlemill.streaming.signals import alerts, merge_stream

SCHEMA = "symbol string, ts_ms long, action string, confidence double"
MIN = 60_000


def _run(spark, rows, path, per_file):
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k : k + per_file], SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    q = merge_stream(feed).writeStream.outputMode("append").option("checkpointLocation", str(path / "cp")).format("parquet").start(str(path / "out"))
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(str(path / "out"))


def test_stream_decides_as_the_batch(spark, tmp_path):
    rows = [(s, (5 * i + i * i % 23) * MIN, "BUY" if i % 9 < 5 else "SELL", float(60 + i * i % 3)) for s in "AB" for i in range(30)]
    rows = sorted(rows, key=lambda r: r[1])
    got = {(r.symbol, r.ts_ms, r.action) for r in alerts(_run(spark, rows, tmp_path, 12)).collect()}
    full = spark.createDataFrame([(*r, 1.0, 2.0, 0.5) for r in rows], SCHEMA + ", entry double, target double, stop double")
    assert got == {(r.symbol, r.first_ms, r.action) for r in merge_signals(full).collect()}


def test_skips_do_not_move_the_stored_time(spark, tmp_path):
    rows = [("A", 0, "BUY", 80.0), ("A", 15 * MIN, "BUY", 80.0), ("A", 21 * MIN, "BUY", 80.0), ("A", 22 * MIN, "BUY", 81.0), ("A", 1 * MIN, "SELL", 90.0), ("A", None, "BUY", 1.0)]
    got = [r.decision for r in _run(spark, rows[:4], tmp_path / "x", 1).orderBy("ts_ms").collect()]
    assert got == ["append", "skip", "append", "update"]
    late = _run(spark, rows, tmp_path / "y", 2)
    assert late.count() == 5 and late.where("ts_ms = 60000").first().decision == "skip"
