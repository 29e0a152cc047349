import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.functions import options
from candlemill.operators import setups, structure

BAR = "symbol string, ts_ms long, o double, h double, l double, c double, v double"
OPEN = 19_700 * 86_400_000 - 19_800_000 + 555 * 60_000  # 09:15 at +05:30
FIVE = 300_000


def _frame(spark, days, symbol="A"):
    rows = [(symbol, OPEN + d * 86_400_000 + k * FIVE, *map(float, b), 1.0) for d, bars in enumerate(days) for k, b in enumerate(bars)]
    return spark.createDataFrame(rows, BAR)


def _mirror(bars, about=200.0):
    return [(about - o, about - low, about - h, about - c) for o, h, low, c in bars]


YESTERDAY = [(100, 110, 90, 100)] * 6
#: A swing low at 100, a sweep of yesterday's high, a break of the swing low, a retest of the block, and the run to the target.
TODAY = [
    (104, 105, 103, 104), (104, 104, 101, 102), (102, 102, 100, 101), (101, 104, 101, 104), (104, 107, 103, 106), (106, 108, 105, 108), (108, 113, 107, 109),
    (109, 110, 106, 107), (107, 108, 104, 105), (105, 105, 99, 99), (99, 101, 97, 98), (98, 110, 98, 105), (105, 106, 95, 96), (96, 97, 86, 88), (88, 90, 80, 82),
]


def _events(spark, today, **own):
    table = setups.variants(spark, {"v": {"min_sweep": 1.0, "stop_buffer": 1.0, "min_risk": 1.0, **own}})
    rows = setups.sweep_events(_frame(spark, [YESTERDAY, today]), table, least_bars=5).orderBy("ts_ms").collect()
    return [((r.ts_ms - OPEN - 86_400_000) // FIVE, r.event, r) for r in rows]


def test_textbook_session_and_its_mirror(spark):
    got = _events(spark, TODAY)
    assert [(k, e) for k, e, _ in got][:1] == [(6, "sweep")]
    sweep, trade = got[0][2], next(r for _, e, r in got if e == "trade")
    assert (sweep.direction, sweep.pool, sweep.depth) == ("SHORT", "previous high", 3.0)
    assert [e for k, e, _ in got] == ["sweep", "break", "armed", "filled", "trade"] and [k for k, _, _ in got][1:4] == [9, 9, 11]
    # the last rising candle before the break is the sweep's; its low is sold, the stop stands a point over the highs of bars 4 to 6,
    # and the target is yesterday's low, the nearest pool worth twice the risk
    assert (trade.entry, trade.stop, trade.target, trade.exit, trade.status) == (107.0, 114.0, 90.0, 90.0, "target")
    base = [(100, 110, 90, 100)] * 6
    table = setups.variants(spark, {"v": {"min_sweep": 1.0, "stop_buffer": 1.0, "min_risk": 1.0}})
    flipped = setups.sweep_events(_frame(spark, [_mirror(base), _mirror(TODAY)]), table, least_bars=5).orderBy("ts_ms").collect()
    for (_, e, a), b in zip(got, flipped, strict=True):
        assert (e, a.ts_ms, a.status) == (b.event, b.ts_ms, b.status) and {a.direction, b.direction} == {"LONG", "SHORT"}
        assert all(x is None and y is None or math.isclose(x, 200 - y) for x, y in ((a.entry, b.entry), (a.stop, b.stop), (a.target, b.target), (a.exit, b.exit)))


def _walk(spark, seed, n=60, days=4):
    rng = np.random.default_rng(seed)
    out, c = [], 100.0
    for _ in range(days):
        bars = []
        for _ in range(n):
            o, c = c, c + float(rng.normal(0, 1.5))
            bars.append((o, max(o, c) + float(rng.random()), min(o, c) - float(rng.random()), c))
        out.append(bars)
    return out


def test_events_add_up_and_look_back_only(spark):
    days = _walk(spark, 5)
    table = setups.variants(spark, {"a": {"min_sweep": 0.2, "stop_buffer": 0.5, "min_risk": 0.1, "most_trades": 9}, "b": {"sides": "LONG", "min_sweep": 0.2, "min_risk": 0.1}})
    rows = setups.sweep_events(_frame(spark, days), table, least_bars=10).collect()
    for v in ("a", "b"):
        n = {e: sum(r.event == e and r.variant == v for r in rows) for e in ("sweep", "break", "armed", "filled", "unfilled", "trade")}
        assert n["sweep"] >= n["break"] >= n["armed"] >= n["filled"] + n["unfilled"] >= 1 and n["filled"] == n["trade"]
    assert {r.direction for r in rows if r.variant == "b"} == {"LONG"}
    for r in rows:
        if r.event == "trade":
            assert r.exit == {"stop": r.stop, "target": r.target}.get(r.status, r.exit)
            assert abs(r.target - r.entry) >= 2 * abs(r.entry - r.stop) - 1e-9
    short = [*days[:-1], days[-1][:40]]  # what came before stays as it was
    cut = OPEN + 3 * 86_400_000 + 39 * FIVE
    again = setups.sweep_events(_frame(spark, short), table, least_bars=10).where(F.col("event") != "trade").collect()
    key = lambda r: (r.variant, r.ts_ms, r.event, r.direction, r.entry, r.stop, r.target)
    assert {key(r) for r in again if r.ts_ms < cut} == {key(r) for r in rows if r.event != "trade" and r.ts_ms < cut}
    assert setups.funnel(setups.sweep_events(_frame(spark, days), table, least_bars=10)).count() == 2
    assert setups.sweep_events(_frame(spark, days[:1]), table, least_bars=10).count() == 0


def _swings(bars, span=2):
    tops = [i for i in range(span, len(bars) - span) if all(bars[j][1] <= bars[i][1] for j in range(i - span, i)) and all(bars[j][1] < bars[i][1] for j in range(i + 1, i + span + 1))]
    bottoms = [i for i in range(span, len(bars) - span) if all(bars[j][2] >= bars[i][2] for j in range(i - span, i)) and all(bars[j][2] > bars[i][2] for j in range(i + 1, i + span + 1))]
    return tops, bottoms


def test_marks_against_lists(spark):
    days = _walk(spark, 8, n=50, days=2)
    rows = setups.marked_breaks(_frame(spark, days)).collect()
    for d, bars in enumerate(days):
        tops, bottoms = _swings(bars)
        used, want = set(), []
        for j in range(len(bars)):
            for name, marks, at in (("SHORT", bottoms, 2), ("LONG", tops, 1)):
                free = [i for i in marks if i + 2 < j and (name, i) not in used]
                if free and (bars[j][3] < bars[free[-1]][2] if name == "SHORT" else bars[j][3] > bars[free[-1]][1]):
                    used.add((name, free[-1]))
                    want.append((j, name, free[-1], round(bars[free[-1]][at], 9)))
        base = OPEN + d * 86_400_000
        got = sorted(((r.ts_ms - base) // FIVE, r.direction, (r.from_ms - base) // FIVE, round(r.level, 9)) for r in rows if 0 <= r.ts_ms - base < 86_400_000 - 555 * 60_000)
        assert got == sorted(want) and want


def test_structure_features_against_lists(spark):
    days = _walk(spark, 11, n=45, days=3)
    b = _frame(spark, days).withColumn("action", F.when(F.col("ts_ms") % (3 * FIVE) == 0, "HOLD").when(F.col("ts_ms") % (2 * FIVE) == 0, "BUY").otherwise("SELL"))
    got = {r.ts_ms: r for r in setups.structure_features(b, least=0.3).collect()}
    assert got and all(r.action == "HOLD" or r.ts_ms in got for r in b.collect())
    old, bars, base = days[1], days[2], OPEN + 2 * 86_400_000
    for k in range(len(bars)):
        r = got.get(base + k * FIVE)
        if r is None:
            continue
        way = 1 if (base + k * FIVE) % (2 * FIVE) == 0 else -1
        o, h, low, c = bars[k]
        hi, lo = max(x[1] for x in old), min(x[2] for x in old)
        assert math.isclose(r.smc_pdh_dist_pct, (hi - c) / c * 100) and math.isclose(r.smc_pdl_dist_pct, (c - lo) / c * 100)
        sweep = None
        for i in range(k, 0, -1):
            tops, bottoms = _swings(bars[:i])
            pools = [(hi, -1), (lo, 1), (old[-1][3], -1), (old[-1][3], 1), *((bars[j][1], -1) for j in tops), *((bars[j][2], 1) for j in bottoms)]
            taken = [(bars[i][1] - p if w < 0 else p - bars[i][2], w) for p, w in pools if (bars[i][1] > p > bars[i][3] if w < 0 else bars[i][2] < p < bars[i][3])]
            taken = [x for x in taken if x[0] >= 0.3]
            if taken:
                sweep = (i, max(taken, key=lambda x: x[0]))
                break
        assert r.smc_sweep_age == (k - sweep[0] if sweep else -1)
        if sweep:
            assert math.isclose(r.smc_sweep_depth_pct, sweep[1][0] / c * 100) and r.smc_sweep_agrees == sweep[1][1] * way
        found = None
        tops, bottoms = _swings(bars[: k + 1])
        for j in range(k, 0, -1):
            lows, highs = [i for i in bottoms if i + 2 < j], [i for i in tops if i + 2 < j]
            if lows and bars[j][3] < bars[lows[-1]][2]:
                found = (j, -1)
            elif highs and bars[j][3] > bars[highs[-1]][1]:
                found = (j, 1)
            if found:
                break
        assert r.smc_break_age == (k - found[0] if found else -1) and r.smc_break_agrees == (found[1] * way if found else 0)


def test_error_function():
    x = np.linspace(-6, 26, 4001)
    want = np.array([math.erfc(v) for v in x])
    assert np.max(np.abs(options.erfc(x) - want) / want) < 1e-12


def test_implied_volatility_gives_back_what_made_the_price(spark):
    from candlemill.plans.decisions import f10_implied_vol

    rows = [r for r in f10_implied_vol(spark, "/root/testdata/sf0.001").collect() if r.implied is not None]
    near = [r for r in rows if abs(r.strike - r.forward) < 0.02 * r.forward]
    assert len(near) > 1000 and all(abs(r.implied - r.vol) < 1e-6 for r in near)


def test_breaks_and_marks_agree_on_the_first(spark):
    days = _walk(spark, 2, n=50, days=1)
    marks = setups.marked_breaks(_frame(spark, days)).collect()
    seen = {(r.ts_ms, r.direction) for r in structure.breaks(_frame(spark, days)).collect()}
    first = {d: min((m.ts_ms for m in marks if m.direction == d), default=None) for d in ("LONG", "SHORT")}
    assert all(t is None or (t, d) in seen for d, t in first.items())
    pools = setups.marked_pools(_frame(spark, days)).collect()
    assert pools and all((p.depth is not None) == p.swept and (not p.swept or p.taken_ms > p.ts_ms) for p in pools)


@pytest.mark.parametrize("name", ["sides", "need_gap", "most_trades"])
def test_variants_only_narrow_or_widen(spark, name):
    days = _walk(spark, 7)
    own = {"min_sweep": 0.2, "stop_buffer": 0.5, "min_risk": 0.1}
    table = setups.variants(spark, {"base": own, "other": {**own, name: {"sides": "SHORT", "need_gap": True, "most_trades": 0}[name]}})
    rows = setups.sweep_events(_frame(spark, days), table, least_bars=10).collect()
    n = {v: sum(r.variant == v and r.event == "armed" for r in rows) for v in ("base", "other")}
    assert n["base"] >= n["other"] and (name != "most_trades" or n["other"] == 0)
