from datetime import datetime, timedelta

from candlemill.streaming.feed import read_upserts, stream_bars, upsert

SCHEMA = "tick_id long, symbol string, ts timestamp, price double"


def test_stream_bars_leave_out_the_forming_bar(spark, tmp_path):
    start = datetime(2024, 1, 2, 4, 0)
    ticks = [(i, "A", start + timedelta(minutes=i), 100.0 + i % 7) for i in range(120)]
    for k in range(4):  # each file fetches the last five ticks of the one before again
        spark.createDataFrame(ticks[max(0, 30 * k - 5) : 30 * k + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_bars(feed).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(upsert(str(tmp_path / "out"))).start()
    q.processAllAvailable()
    q.stop()
    got = {r.start: (r.o, r.h, r.l, r.c, r.v) for r in read_upserts(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got
    for at, values in got.items():
        own = [p for _, _, t, p in ticks if at <= t < at + timedelta(minutes=15)]
        assert values == (own[0], max(own), min(own), own[-1], 15.0)
    assert max(got) <= start + timedelta(minutes=75)  # what the watermark has not passed stays inside


def test_upsert_takes_the_latest_version(spark, tmp_path):
    row = lambda c: spark.createDataFrame([("A", datetime(2024, 1, 1), c)], "symbol string, start timestamp, c double")
    write = upsert(str(tmp_path / "t"))
    write(row(1.0), 0)
    write(row(2.0), 1)
    write(row(2.0), 1)
    assert [r.c for r in read_upserts(spark.read.parquet(str(tmp_path / "t"))).collect()] == [2.0]
