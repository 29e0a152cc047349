import os

import pytest

from candlemill import registry
from candlemill.sources.store import BarStore
from tests.oracle import duck, spark_rows

SF = "/root/testdata/sf0.01"
DAY, JAN = 86_400_000, 1_704_067_200_000  # 1 January 2024
PULL = "symbol string, segment string, interval string, ts_ms long, o double, h double, l double, c double, v double, oi double"


def _bar(symbol, day, c=1.0, segment="INDEX", interval="5m", oi=None):
    return (symbol, segment, interval, JAN + day * DAY, c, c, c, c, 1.0, oi)


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("name", [n for n in sorted(registry.oracle_sql()) if "_stored_" in n or n == "a3_sync_log"])
def test_queries_match_their_sql_at_a_larger_size(spark, name):
    columns, want = duck(SF, registry.oracle_sql()[name])
    assert spark_rows(registry.queries()[name](spark, SF)) == (columns, want) and want


def test_a_pull_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    store = BarStore(spark, str(tmp_path))
    write = lambda rows, source, at: {(r.symbol, r.segment, r.interval): (r.rows_added, r.first_ts, r.last_ts) for r in store.write(spark.createDataFrame(rows, PULL), source, at).collect()}
    assert store.log().count() == store.bars().count() == 0
    assert write([], "none", 0) == {} and not _files(tmp_path)
    first = [_bar("A", k) for k in range(0, 90, 3)] + [_bar("B", k) for k in range(10)] + [_bar("A", 5, 7.0, "EQUITY"), _bar("A", 5, 8.0, interval="1d"), (None, *_bar("A", 1)[1:]), _bar("A", 2, None)]
    assert write(first, "x", 1)["A", "INDEX", "5m"] == (30, JAN, JAN + 87 * DAY)
    before = _files(tmp_path / "bars")
    assert len(before) == len({os.path.dirname(f) for f in before}) == 5  # three months of A, one of B, one of the daily series
    assert write([_bar("A", 33, 5.0), _bar("A", 34, 6.0, oi=3.0), _bar("A", 34, 6.0, oi=3.0)], "y", 2) == {("A", "INDEX", "5m"): (1, JAN + 33 * DAY, JAN + 34 * DAY)}
    after = _files(tmp_path / "bars")
    changed = {os.path.relpath(os.path.dirname(f), tmp_path / "bars") for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"interval=5m/symbol=A/month=202402"}
    got = {r.ts_ms: (r.c, r.oi) for r in store.read("A", "INDEX", "5m").collect()}
    assert len(got) == 31 and got[JAN + 33 * DAY] == (5.0, None) and got[JAN + 34 * DAY] == (6.0, 3.0)
    assert write([_bar("A", 34, 6.0, oi=3.0)], "y", 3)["A", "INDEX", "5m"][0] == 0  # the same rows again
    assert {(r.symbol, r.source) for r in store.bars().where("ts_ms = %d" % (JAN + 33 * DAY)).collect()} == {("A", "y")}
    assert [(r.source, r.rows_added) for r in store.log().where("symbol = 'A' and segment = 'INDEX' and interval = '5m'").orderBy("synced_at").collect()] == [("x", 30), ("y", 1), ("y", 0)]


def test_reads_are_pruned_and_bounded(spark, tmp_path):
    store = BarStore(spark, str(tmp_path))
    store.write(spark.createDataFrame([_bar(s, k) for s in "AB" for k in range(120)] + [_bar("C", 0)], PULL), "x", 1)
    own = store.read("A", "INDEX", "5m", JAN + 40 * DAY, JAN + 50 * DAY)
    files = own._jdf.queryExecution().toString()
    assert [r.ts_ms for r in own.collect()] == [JAN + k * DAY for k in range(40, 51)]
    assert "PartitionFilters" in files and "month" in files.split("PartitionFilters")[1].split("]")[0]
    assert [r.ts_ms for r in store.read("B", "INDEX", "5m", limit=3).collect()] == [JAN + k * DAY for k in range(117, 120)]
    assert store.read("A", "FUTURE", "5m").count() == 0
    assert {(r.symbol, r.ts_ms) for r in store.latest(2).collect()} == {("C", JAN), *((s, JAN + k * DAY) for s in "AB" for k in (118, 119))}
    assert {(r.symbol, r.ts_ms) for r in store.latest(45).where("symbol = 'A'").collect()} == {("A", JAN + k * DAY) for k in range(75, 120)}
    assert store.coverage("Z", "INDEX", "5m").first().n == 0 and store.coverage("A", "INDEX", "5m").first().last_ms == JAN + 119 * DAY
    row = store.inventory().where("symbol = 'A'").first()
    assert (row.n, str(row.first_day), str(row.last_day)) == (120, "2024-01-01", "2024-04-29")
