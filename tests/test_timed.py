import json
import random

import pytest

from candlemill.functions.options import measures
from candlemill.operators import grading as batch
from candlemill.streaming import books, grading, timed
from candlemill.streaming.ordered import ROCKS, use_timers
from tests.test_books import MIN, OPEN

DAY = 86_400_000


@pytest.fixture(autouse=True)
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    use_timers(spark)
    assert spark.conf.get(key) == ROCKS
    yield
    spark.conf.set(key, before)


def _stream(spark, tmp_path, parts, schema, f):
    """Events after each part, every one a query of its own on one checkpoint, and the state rows that the last one leaves."""
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    seen = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = f(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination(240)
        assert q.exception() is None
        seen.append([tuple(r) for r in spark.read.parquet(out).collect()])
    left = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, q.recentProgress) if p["stateOperators"]]
    return seen, left[-1]


def _jumbled(rows, at, minutes, rng):
    """Rows in an order in which none is more than so many minutes late."""
    return sorted(rows, key=lambda r: r[at] + rng.random() * minutes * MIN)


def test_grading_expires_silent_symbols_and_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    signals = [(f"{s}{k}", s, OPEN + 20 * k * MIN, "BUY" if k % 2 else "SELL", 100.0, 100.0 + (3.5 if k % 2 else -2.8), 100.0 - (2.2 if k % 2 else -4.5)) for s in "AB" for k in range(6)]
    bars = [("A", OPEN + 5 * k * MIN, 100 + (h := rng.random() * 4), 100 - rng.random() * 3, 100 + h / 2) for k in range(40)]
    sdf = spark.createDataFrame(signals, "sid string, symbol string, ts_ms long, action string, entry double, target double, stop double")
    bdf = spark.createDataFrame(bars, "symbol string, ts_ms long, h double, l double, c double")
    want = {(r.sid, r.status, r.resolved_price, r.resolved_ms, r.mfe, r.mae) for r in batch.grade(sdf, bdf).collect()}
    assert {w[1] for w in want} == {"target", "stop", "expired"}
    rows = grading.feed(sdf, bdf)
    assert {tuple(r)[1:] for r in timed.grade_timed(rows).collect()} == want  # over a table
    given = _jumbled([tuple(r) for r in rows.collect()], 1, 8, rng)
    later = [("Z", OPEN + k * DAY, None, None, None, None, None, 1.0, 1.0, 1.0) for k in (2, 3, 4)]
    parts = [given[:20], given[20:41], given[41:], later[:1], later[1:2], later[2:]]
    seen, left = _stream(spark, tmp_path, parts, grading.FEED, timed.grade_timed)
    assert {r[1:] for r in seen[-1]} == want and len(seen[-1]) == len(want)
    assert not any(r[2] == "expired" for r in seen[2]) and {r[1] for r in seen[-1] if r[2] == "expired" and r[0] == "B"} == {f"B{k}" for k in range(6)}
    assert left <= 4  # what waits of Z and its timer: A and B have no state


def _row(minute, what, **own):
    base = dict.fromkeys(timed.PAPER_NAMES) | {"ts_ms": OPEN + minute * MIN, "what": what} | own
    return (own.get("symbol", "A"), *(base[n] for n in timed.PAPER_NAMES))


def _quotes(minute, volume=9.0, spot=100.0):
    out, expiry = [], OPEN + 3 * DAY
    for k in range(90, 111, 2):
        for call in (True, False):
            price = float(measures([spot], [k], [(expiry - OPEN - minute * MIN) / books.YEAR_MS], [0.25], [call], 0.065)[0][0])
            if price > 0.06:
                out.append(_row(minute, "quote", strike=float(k), is_call=call, bid=price - 0.05, ask=price + 0.05, volume=volume, expiry_ms=expiry))
    return out


def _offer(minute, sid, action, **own):
    way = 1 if action == "BUY" else -1
    return _row(minute, "offer", sid=sid, action=action, entry=100.0, target=100.0 + 10 * way, stop=100.0 - 5 * way, **own)


def test_paper_book_by_event_time(spark, tmp_path):
    rng = random.Random(5)
    rows = [_row(5 * k, "bar", h=101.0, l=99.0, c=100.0) for k in range(12)] + _quotes(7) + _quotes(58) + _quotes(200, volume=0.0)
    rows += [_offer(8, "a", "BUY"), _offer(9, "b", "SELL"), _offer(10, "c", "BUY"), _offer(40, "d", "SELL", declined="vix"), _offer(59, "e", "SELL", declined="vix")]
    rows += [_offer(201, "f", "BUY", declined="x"), _offer(301, "g", "BUY", declined="x"), _offer(325, "h", "BUY"), (None, *_row(1, "bar")[1:]), _row(3, "other")]
    schema = "symbol string, " + timed.PAPER
    book = lambda r: timed.paper_timed(r, min_points=2.0)
    whole = {tuple(r) for r in book(spark.createDataFrame(rows, schema)).collect()}
    names = [c.split()[0] for c in books.CLOSED.split(", ")]
    by = {(r["sid"], r["event"]): r for r in (dict(zip(names, w)) for w in whole)}
    assert set(by) == {("a", "opened"), ("b", "opened"), ("c", "opened"), ("c", "squareoff"), ("d", "blocked"), ("e", "opened"), ("f", "blocked"), ("g", "blocked"), ("h", "blocked"), ("a", "squareoff"), ("b", "squareoff"), ("e", "squareoff")}
    assert [by[s, "blocked"]["declined"] for s in "dfgh"] == ["no strike", "no strike", "too late", "past square-off"]
    assert (by["c", "opened"]["kind"], by["c", "opened"]["declined"]) == ("shadow", "2 open")
    end = by["a", "squareoff"]
    assert end["ts_ms"] == timed.square_off(OPEN) == OPEN + 320 * MIN and end["exit_index"] == 100.0 and by["e", "squareoff"]["kind"] == "shadow"
    late = [("Z", *_row(0, "bar", ts_ms=OPEN + k * DAY, h=1.0, l=1.0, c=1.0)[1:]) for k in (2, 3, 4)]
    given = _jumbled(rows, 1, 8, rng)
    seen, left = _stream(spark, tmp_path, [given[:30], given[30:], late[:1], late[1:2], late[2:]], schema, book)
    assert set(seen[-1]) == whole and len(seen[-1]) == len(whole)
    assert not any(r[5] == "squareoff" for r in seen[1]) and left <= 4


def test_strikes_are_chosen_by_delta_and_cost():
    book = timed.TimedPaperBook(None, 0.065, DAY, 2.0)
    assert book.choose(True, OPEN) is None
    for q in _quotes(0):
        book.row(q[1:])
    call, put = book.choose(True, OPEN), book.choose(False, OPEN)
    years = (OPEN + 3 * DAY - OPEN) / books.YEAR_MS
    for pick, is_call in ((call, True), (put, False)):
        delta = float(measures([100.0], [pick["strike"]], [years], [pick["iv"]], [is_call], 0.065)[1][0])
        assert 0.35 <= delta <= 0.70 and abs(pick["iv"] - 0.25) < 0.02 and pick["ask"] > pick["bid"]
    book.row(_row(1, "quote", strike=call["strike"], is_call=True, bid=call["bid"] - 1, ask=call["ask"] + 1, volume=9.0, expiry_ms=OPEN + 3 * DAY)[1:])
    other = book.choose(True, OPEN + MIN)
    assert other is None or other["strike"] != call["strike"]  # a wide spread costs more
    assert book.due(OPEN + 20 * MIN) == [] and book.choose(False, OPEN + 20 * MIN) is None and book.state() is None


def test_cross_book_ends_at_square_off_without_a_bar(spark, tmp_path):
    rng = random.Random(2)
    dip = [110, 108, 104, 100, 97, 96, 99, 104, 109, 112, 108, 102, 97, 99, 106, 111, 104, 98, 95, 101, 108, 106, 107, 107.5]
    bar = "symbol string, ts_ms long, o double, h double, l double, c double, v double"
    rows = [(s, OPEN + k * 5 * MIN, float(c), c + 1.0, c - 1.0, float(c), 1.0) for s in "AB" for k, c in enumerate(dip)]
    f = lambda r: timed.cross_timed(r, period=3, warmup=2, stop_pts=9.0, min_rr=0.1, fill_bar=False)
    whole = sorted(map(tuple, f(spark.createDataFrame(rows, bar)).collect()), key=repr)
    plain = books.CrossBook(None, 3, 20, 2, 9.0, 0.1, 900)
    own = [("A", *timed.TimedCrossBook._named([e])[0]) for r in rows[: len(dip)] for e in plain.bar(timed.SimpleNamespace(**dict(zip(("ts_ms", "o", "h", "l", "c", "v"), r[1:]))))]
    ended = [r for r in whole if r[0] == "A" and r[3] == "closed" and r[1] == OPEN + 320 * MIN]
    assert ended and sorted([*own, *ended], key=repr) == [r for r in whole if r[0] == "A"]
    assert {(r[8], r[9]) for r in ended} == {(107.5, "squareoff")}
    later = [("Z", OPEN + k * DAY, 1.0, 1.0, 1.0, 1.0, 1.0) for k in (2, 3, 4)]
    given = _jumbled(rows, 1, 8, rng)
    seen, _ = _stream(spark, tmp_path, [given[:20], given[20:], later[:1], later[1:2], later[2:]], bar, f)
    assert sorted((r for r in seen[-1] if r[0] != "Z"), key=repr) == whole


def test_a_live_target_sees_the_bar_of_the_fill():
    prices = [110, 108, 104, 100, 97, 96, 99, 104, 109, 114, 118]
    bars = [(OPEN + k * 5 * MIN, float(c), c + 1.0, c - 1.0, float(c), 1.0) for k, c in enumerate(prices)]
    target = {}
    for fill_bar in (True, False):
        book = timed.TimedCrossBook(None, fill_bar, 3, 4, 2, 9.0, 0.1, 900)
        said = [e for b in bars for e in book.row(b) if e[2] in ("opened", "refused")]
        assert said and len({e[0] for e in said}) == 1
        k = (said[0][0] - OPEN) // (5 * MIN)
        target[fill_bar] = {e[5] for e in said}
        seen = [b[2] for b in bars[: k + 1]][-4:] if fill_bar else [b[2] for b in bars[:k]][-4:]
        assert target[fill_bar] == {max(seen)}
    assert target[True] != target[False]
