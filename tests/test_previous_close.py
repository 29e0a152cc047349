from pyspark.sql import functions as F

from candlemill.operators import regime


def test_trades_are_not_shuffled_to_meet_the_day(spark, tmp_path):
    """The closes, a row a day, go to the trades at any setting of the join threshold; a day that is not archived has none."""
    spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 12).cast("int")).alias("day"), F.col("id")).write.parquet(str(tmp_path / "t"))
    vix = spark.range(10).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") + 10.0).alias("close"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = regime.with_previous_close(spark.read.parquet(str(tmp_path / "t")), vix)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.vix for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: None if k % 12 in (0, 10, 11) else 9.0 + k % 12 for k in range(60)}
