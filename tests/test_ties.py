"""Queries and their SQL on events whose ids repeat with other values, as in tables put together."""

import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from candlemill import registry
from candlemill.functions.scan import ema, trailing
from tests.oracle import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("ties")
    for t in ("customer", "lineitem", "orders"):
        (d / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    e = spark.read.parquet(f"{SF}/events.parquet")
    copies = e.withColumn("copy", F.explode(F.array(*map(F.lit, range(4)))))
    copies = copies.withColumn("value", F.round(F.pmod(F.col("value") + (F.col("copy") * 37) % 100, F.lit(300.0)), 2)).withColumn("event_id", F.when(F.col("event_id") % 97 != 0, F.col("event_id")))
    copies.drop("copy").orderBy(F.xxhash64("value", "ts")).write.parquet(str(d / "events.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ["a2_latest_bars", "a2_stored_latest", "a3_stored_upsert", "a8_paged_landing", "c16_previous_close", "c19_streak", "c20_returns", "d11_latest_prices"])
def test_ties_are_decided(spark, repeated, name):
    columns, want = duck(repeated, registry.oracle_sql()[name])
    assert spark_rows(registry.queries()[name](spark, repeated)) == (columns, want)


EXACT = [
    "a2_stored_latest",
    "a3_stored_upsert",
    "a3_upsert",
    "a8_paged_landing",
    "b13_overall_calls",
    "b13_watch_calls",
    "c16_previous_close",
    "c19_streak",
    "c1_ema",
    "c1_trailing_ema",
    "c20_returns",
]


@pytest.mark.parametrize("name", EXACT)
def test_ties_leave_equal_rows_to_the_last_digit(spark, repeated, name):
    df = registry.queries()[name](spark, repeated)
    sql = registry.oracle_sql()[name].replace("FROM events", f"FROM '{repeated}/events.parquet/*.parquet'")
    got = duckdb.sql(sql)
    order = [df.columns.index(c) for c in got.columns]
    assert sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr) == sorted(got.fetchall(), key=repr)


def test_running_sums_are_equal_to_the_last_digit(spark, tmp_path):
    """Sixty copies make volumes that put the session's price between two sixth decimals."""
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("event_type = 'error'")
    e.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("event_id", F.col("event_id") + F.col("copy") * 100_000).drop("copy").write.parquet(str(tmp_path / "events.parquet"))
    name, exact = "c10_running_vwap", lambda data: sorted(tuple(r) for r in data)
    sql = registry.oracle_sql()[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert exact(registry.queries()[name](spark, str(tmp_path)).collect()) == exact(duckdb.sql(sql).fetchall())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """As repeated, some rows without an id, a type, a time or a value, and some values that are no number."""
    d = tmp_path_factory.mktemp("odd")
    for t in ("customer", "lineitem", "orders"):
        (d / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("copy", F.explode(F.array(*map(F.lit, range(4)))))
    at = lambda seed: F.pmod(F.xxhash64("event_id", "copy", F.lit(seed)), F.lit(40))
    value = F.when(at(1) == 1, float("nan")).when(at(1) > 1, F.round(F.pmod(F.col("value") + F.col("copy") * 37, F.lit(300.0)), 2))
    e = e.withColumns({"value": value, "ts": F.when(at(2) > 0, F.col("ts")), "event_type": F.when(at(3) > 3, F.col("event_type")), "event_id": F.when(at(4) > 0, F.col("event_id"))})
    e.drop("copy").orderBy(F.xxhash64("value", "ts")).write.parquet(str(d / "events.parquet"))
    return str(d)


ODD = [
    "a2_stored_latest",
    "a3_stored_upsert",
    "a8_paged_landing",
    "c16_previous_close",
    "b13_watch_calls",
    "c1_ema",
    "c1_trailing_ema",
    "b13_overall_calls",
]


@pytest.mark.parametrize("name", ODD)
def test_odd_events_leave_equal_rows(spark, odd, name):
    df = registry.queries()[name](spark, odd)
    got = duckdb.sql(registry.oracle_sql()[name].replace("FROM events", f"FROM '{odd}/events.parquet/*.parquet'"))
    order = [df.columns.index(c) for c in got.columns]
    plain = lambda v: "nan" if v != v else v
    rows = lambda data: sorted((tuple(plain(v) for v in r) for r in data), key=repr)
    assert rows(tuple(r[i] for i in order) for r in df.collect()) == rows(got.fetchall())


SERIES = [
    "c16_previous_close",
    "b13_watch_calls",
    "c1_ema",
    "c1_trailing_ema",
    "b13_overall_calls",
]


@pytest.mark.parametrize("name", SERIES)
def test_bars_without_a_symbol_are_a_series(spark, odd, name):
    assert registry.queries()[name](spark, odd).where("symbol is null").count() > 0


def test_an_average_stays_no_number_and_a_trailing_one_recovers(spark):
    """A value that is no number lies more chunks back than the scan puts together."""
    rows = [(s, i, float("nan") if i == 10 else float(i % 7)) for s in ("a", None) for i in range(2500)]
    b = spark.createDataFrame(rows, "symbol string, ts_ms long, c double")
    got = trailing(ema(b, "c", 20, "whole"), "c", 20, 375, "late").orderBy("ts_ms").collect()
    assert len(got) == 5000
    assert all((r.whole != r.whole) == (r.ts_ms >= 10) for r in got)
    assert all((r.late != r.late) == (10 <= r.ts_ms < 385) for r in got)


def events(spark, tmp_path, rows):
    """A folder with events of (event_id, ts, event_type, value) alone."""
    e = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double")
    e.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def exact(spark, d, name):
    """Rows of the query and of its SQL, to the last digit."""
    df = registry.queries()[name](spark, d)
    got = duckdb.sql(registry.oracle_sql()[name].replace("FROM events", f"FROM '{d}/events.parquet/*.parquet'"))
    order = [df.columns.index(c) for c in got.columns]
    return sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr), sorted(got.fetchall(), key=repr)


def ends(spark, tmp_path, year):
    """Forty bars of two events, the second half a millisecond before the bar's end or less."""
    at = lambda k, tail: f"{year}-01-20 {10 + k // 4 % 10:02d}:{k % 4 * 15 + 14:02d}:{tail}"
    rows = [(2 * k + i, at(k, tail), "a", v) for k in range(40) for i, tail, v in ((0, "30", k * 7 % 50 + 1.0), (1, f"59.{999_500 + k}", k * 37 % 90 + 1.0))]
    return events(spark, tmp_path, rows)


@pytest.mark.parametrize("year", [2024, 1950])
@pytest.mark.parametrize("name", ["a3_upsert", "a3_stored_upsert", "a8_paged_landing", "b1_calendar_keys"])
def test_a_bars_last_half_millisecond_is_its_own(spark, tmp_path, name, year):
    got, want = exact(spark, ends(spark, tmp_path, year), name)
    assert got == want
    if name == "a3_upsert":
        volumes = [r[-1] for r in got]
        assert volumes == [2.0] * 40 + [1.0] * (year == 2024)


def test_streaks_count_a_bars_last_half_millisecond(spark, tmp_path):
    got, want = exact(spark, ends(spark, tmp_path, 2024), "c19_streak")
    assert got == want
    closes = [k * 37 % 90 for k in range(40)]
    run, streaks = 0, [0]
    for a, b in zip(closes, closes[1:]):
        run = max(run, 0) + 1 if b > a else min(run, 0) - 1
        streaks.append(run)
    assert [r[-1] for r in got] == streaks


def test_large_prices_keep_their_digits(spark, tmp_path):
    """Three prices that round(x, 6) of DuckDB changes, and one past its decimals."""
    values = [2.87e12, 3872839470.9300003, 9007199254.740993, 1e35]
    d = events(spark, tmp_path, [(k, f"2024-01-20 {10 + k}:00:00", "a", v) for k, v in enumerate(values)])
    got, want = exact(spark, d, "a3_upsert")
    assert got == want
    assert got[0][2] == 2870000000100.0


def test_returns_leave_out_closes_of_zero(spark, tmp_path):
    """A return from a close of 0 is 0, and none of the last 20 that the deviation takes."""
    values = [-100.0 if k in (3, 25) else k * 37 % 90 + 1.0 for k in range(60)]
    d = events(spark, tmp_path, [(k, f"2024-01-20 {k // 4:02d}:{k % 4 * 15:02d}:00", "a", v) for k, v in enumerate(values)])
    got, want = exact(spark, d, "c20_returns")
    assert got == want
    c, one = [v + 100 for v in values], []
    for k, (_, _, five, twenty, vol) in enumerate(got):
        one += [(c[k] - c[k - 1]) / c[k - 1] * 100] if k and c[k - 1] else []
        assert five == pytest.approx((c[k] - c[k - 5]) / c[k - 5] * 100 if k >= 5 and c[k - 5] else 0.0, abs=1e-6)
        assert twenty == pytest.approx((c[k] - c[k - 20]) / c[k - 20] * 100 if k >= 20 and c[k - 20] else 0.0, abs=1e-6)
        assert vol == pytest.approx(statistics.pstdev(one[-20:]) if len(one) >= 20 else 0.0, abs=1e-6)


def test_returns_of_large_prices_leave_equal_rows(spark, tmp_path):
    d = events(spark, tmp_path, [(k, f"2024-01-20 {k // 4:02d}:{k % 4 * 15:02d}:00", "a", (k * 37 % 90 + 0.37) * (1e9 if k % 3 else 1.0)) for k in range(90)])
    got, want = exact(spark, d, "c20_returns")
    assert got == want
