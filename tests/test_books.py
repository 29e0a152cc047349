import pandas as pd

from candlemill.operators import replay
from candlemill.streaming import books

OPEN = 19_700 * 86_400_000 - 19_800_000 + 600 * 60_000  # 10:00 at +05:30
MIN = 60_000
NAMES = [x.split()[0] for x in books.ROW.split(", ")]


def _row(minute, what, **own):
    base = dict.fromkeys(NAMES) | {"symbol": "A", "ts_ms": OPEN + minute * MIN, "what": what}
    return tuple((base | own)[n] for n in NAMES)


def _offer(minute, sid, action, declined=None, entry=100.0):
    way = 1 if action == "BUY" else -1
    return _row(minute, "offer", sid=sid, action=action, declined=declined, entry=entry, target=entry + 10 * way, stop=entry - 5 * way, strike=100.0, is_call=way > 0, bid=4.0, ask=4.4, iv=0.2, expiry_ms=OPEN + 3 * 86_400_000)


def _run(spark, tmp_path, parts, schema, f):
    """Events of micro-batches, each run as a query of its own on one checkpoint, so state is restored every time."""
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = f(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
    return spark.read.parquet(out).collect()


def test_paper_book_over_restarts(spark, tmp_path):
    first = [
        _offer(0, "a", "BUY"), _offer(1, "b", "BUY"), _offer(2, "c", "SELL"), _offer(3, "d", "SELL", declined="vix"), _row(5, "bar", h=104.0, l=96.0, c=101.0),
    ]
    second = [
        _row(10, "quote", strike=100.0, is_call=True, bid=9.0), _row(11, "bar", h=111.0, l=101.0, c=110.0), _offer(12, "e", "BUY"), _offer(40, "f", "BUY", entry=110.0),
        _row(330, "bar", h=111.0, l=109.0, c=110.5), _row(1, "other"),
    ]
    got = {(r.sid, r.event): r for r in _run(spark, tmp_path, [first, second], books.ROW, lambda s: books.paper_book(s, min_points=2.0))}
    assert {k for k in got} == {
        ("a", "opened"), ("b", "blocked"), ("c", "opened"), ("d", "opened"), ("a", "target"), ("c", "stop"), ("d", "stop"), ("e", "blocked"), ("f", "opened"), ("f", "squareoff"),
    }
    assert (got["b", "blocked"].declined, got["e", "blocked"].declined) == ("held", "cooldown")
    assert got["d", "opened"].kind == "shadow" and got["d", "stop"].declined == "vix" and got["c", "stop"].kind == "live"
    a = got["a", "target"]
    assert (a.exit_index, a.paid, a.received) == (110.0, 4.4, 9.0) and abs(a.net - ((9.0 - 4.4) * 75 - a.charges)) < 1e-9 and abs(a.points - a.net / 75) < 1e-9
    assert got["c", "stop"].received < got["c", "stop"].paid  # priced by the model: a put after a rise


def test_a_full_book_follows_as_shadow():
    book = books.PaperBook(None, 0.065, 86_400_000, 0.0)
    offers = pd.DataFrame([_offer(0, "a", "BUY"), _offer(0, "b", "SELL"), _offer(1, "c", "BUY")], columns=NAMES)
    assert [book.offer(r)[:2] for r in offers.itertuples(index=False)] == [("opened", "live"), ("opened", "live"), ("opened", "shadow")]
    again = books.PaperBook(book.state(), 0.065, 86_400_000, 0.0)
    assert len(again.open) == 3


def test_cross_book_equals_the_replay(spark, tmp_path):
    dip = [110, 108, 104, 100, 97, 96, 99, 104, 109, 112, 108, 102, 97, 99, 106, 111, 104, 98, 95, 101, 108, 113, 107, 100]
    rows = [("A", OPEN + k * 5 * MIN, float(c), c + 1.0, c - 1.0, float(c), 1.0) for k, c in enumerate(dip)]
    bar = "symbol string, ts_ms long, o double, h double, l double, c double, v double"
    got = _run(spark, tmp_path, [rows[:9], rows[9:10] + rows[3:4], rows[10:]], bar, lambda s: books.cross_book(s, period=3, warmup=2, stop_pts=3.0, min_rr=1.5))
    table = spark.createDataFrame([("gated", "both", 3.0, 1.5), ("ungated", "both", 3.0, 0.0)], "variant string, sides string, stop_pts double, min_rr double")
    want = replay.cross_trades(spark.createDataFrame(rows, bar), table, period=3, warmup=2, least_bars=5).collect()
    opened = {(r.arm, r.ts_ms, r.direction, r.entry, r.target, r.stop) for r in got if r.event == "opened"}
    assert opened and opened == {(r.variant, r.entry_ms, r.direction, r.entry, r.target, r.stop) for r in want if r.verdict == "taken"}
    closed = {(r.arm, r.ts_ms, r.exit, r.reason) for r in got if r.event == "closed"}
    assert closed == {(r.variant, r.exit_ms, r.exit, r.status) for r in want if r.verdict == "taken" and (r.status != "squareoff")}
    for arm in books.ARMS:  # every cross with a bar after it is ruled on once
        ruled = [r for r in got if r.arm == arm and r.event in ("opened", "refused")]
        assert len(ruled) == len({r.ts_ms for r in ruled}) == len([r for r in want if r.variant == arm and r.ts_ms < rows[-1][1]])
