"""The sweep setup: a pool is swept, structure breaks the other way, and the retest of the block behind it is traded."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.market import SQUARE_OFF, day_minutes
from candlemill.operators.indicators import of_day, session_day, swings

#: A variant's columns with the setup's own values; fixed values.
VARIANT = {
    "sides": "both", "min_sweep": 2.0, "break_bars": 12, "entry_bars": 12, "block_bars": 10, "stop_buffer": 5.0, "min_risk": 8.0, "max_risk": 60.0,
    "min_rr": 2.0, "most_trades": 1, "need_gap": False, "cutoff": 885,
}
EVENT = "symbol string, day int, variant string, ts_ms long, event string, direction string, pool string, depth double, kind string, entry double, stop double, target double, exit double, status string"


def variants(spark, rows: dict[str, dict]) -> DataFrame:
    """A table of named variants; what one leaves out has the setup's own value."""
    kinds = {str: "string", float: "double", int: "int", bool: "boolean"}
    schema = "variant string, " + ", ".join(f"{c} {kinds[type(v)]}" for c, v in VARIANT.items())
    return spark.createDataFrame([(name, *(own.get(c, v) for c, v in VARIANT.items())) for name, own in rows.items()], schema)


def with_sessions(bars: DataFrame, span: int, least_bars: int) -> DataFrame:
    """Bars of sessions of enough bars after such a one, with swings, minutes and the session before's high, low and close."""
    b = swings(bars, span)
    days = b.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.max("h").alias("hi"), F.min("l").alias("lo"), F.max_by("c", "ts_ms").alias("lc"))
    w = Window.partitionBy("symbol").orderBy("day")
    before = days.select("symbol", "day", "n", *(F.lag(c).over(w).alias(f"old_{c}") for c in ("n", "hi", "lo", "lc")))
    before = before.where((F.col("n") >= least_bars) & (F.col("old_n") >= least_bars)).drop("n", "old_n")
    return b.join(before, ["symbol", "day"]).withColumn("minutes", day_minutes(F.col("ts_ms")))


#: Most variants of one grid.
MOST_VARIANTS = 10_000


def grid(table: DataFrame) -> pd.DataFrame:
    """The rows of a table of variants, which are parameters and few."""
    rows = table.limit(MOST_VARIANTS + 1).toPandas()
    if len(rows) > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants")
    return rows


class _Day:
    """A session's arrays and what is known of its structure at a bar. way is 1 for longs, -1 for shorts."""

    def __init__(self, s: pd.DataFrame, span: int):
        self.at, self.o, self.h, self.l, self.c = (s[x].to_numpy() for x in ("ts_ms", "o", "h", "l", "c"))
        self.minutes, self.span = s["minutes"].to_numpy(), span
        self.tops, self.bottoms = np.flatnonzero(s["swing_high"].to_numpy(bool)), np.flatnonzero(s["swing_low"].to_numpy(bool))
        hi, lo, close = (float(s[x].iloc[0]) for x in ("old_hi", "old_lo", "old_lc"))
        self.old = [(hi, 1, "previous high"), (lo, -1, "previous low"), (close, 1, "previous close"), (close, -1, "previous close")]
        self.deepest: dict[int, tuple[float, int, str] | None] = {}  # by bar, for all variants

    def known(self, where: np.ndarray, i: int) -> np.ndarray:
        return where[: np.searchsorted(where, i - self.span, side="right")]

    def pools(self, i: int) -> list[tuple[float, int, str]]:
        """(price, 1 above or -1 below, name) of the pools seen at bar i."""
        own = [(float(self.h[k]), 1, "session high") for k in self.known(self.tops, i)] + [(float(self.l[k]), -1, "session low") for k in self.known(self.bottoms, i)]
        return self.old + own

    def sweep(self, i: int, least: float) -> tuple[float, int, str] | None:
        """(depth, way of the reversal, pool) of the deepest pool that bar i trades through and closes back from."""
        if i not in self.deepest:
            best = None
            for price, side, name in self.pools(i - 1):
                depth = self.h[i] - price if side > 0 else price - self.l[i]
                back = self.c[i] < price if side > 0 else self.c[i] > price
                if depth > 0 and back and (best is None or depth > best[0]):
                    best = (float(depth), -side, name)
            self.deepest[i] = best
        best = self.deepest[i]
        return best if best is not None and best[0] >= least else None

    def reference(self, i: int, way: int) -> float:
        """The level whose break by the close confirms the way: the last swing known at bar i, else the day's extreme so far."""
        k = self.known(self.tops if way > 0 else self.bottoms, i)
        price = self.h if way > 0 else self.l
        return float(price[k[-1]]) if len(k) else float(price[: i + 1].max() if way > 0 else price[: i + 1].min())

    def block(self, i: int, way: int, lookback: int) -> int | None:
        """The last candle against the way before bar i."""
        first = max(i - lookback, 0)
        against = self.c[first:i] < self.o[first:i] if way > 0 else self.c[first:i] >= self.o[first:i]
        k = np.flatnonzero(against)
        return first + int(k[-1]) if len(k) else None

    def gap(self, first: int, last: int, way: int) -> float:
        """Height of the largest imbalance around bars first to last, 0 for none."""
        k = np.arange(max(first, 1), last + 1)
        return max(0.0, float((self.l[k + 1] - self.h[k - 1] if way > 0 else self.l[k - 1] - self.h[k + 1]).max())) if len(k) else 0.0

    def kind(self, i: int, way: int) -> str:
        """Whether a break at bar i goes on (BOS) or changes the character of the swings on the other side (CHoCH)."""
        k, price = (self.known(self.bottoms, i), self.l) if way > 0 else (self.known(self.tops, i), self.h)
        return "CHoCH" if len(k) > 1 and (price[k[-1]] - price[k[-2]]) * way < 0 else "BOS"

    def exit(self, i: int, way: int, stop: float, target: float) -> tuple[int, float, str]:
        """(bar, price, status) at which a position held from bar i ends: the stop before the target, at square-off or with the session."""
        stopped = self.l[i:] <= stop if way > 0 else self.h[i:] >= stop
        reached = self.h[i:] >= target if way > 0 else self.l[i:] <= target
        over = self.minutes[i:] >= SQUARE_OFF
        over[-1] = True
        j = int(np.flatnonzero(stopped | reached | over)[0])
        return i + j, *((stop, "stop") if stopped[j] else (target, "target") if reached[j] else (float(self.c[i + j]), "squareoff"))


def _order(day: _Day, i: int, swept: int, way: int, v) -> tuple[float, float, float, str] | None:
    """(entry, stop, target, kind) that rests after a break at bar i of a sweep at bar swept, None if a rule forbids it."""
    block = day.block(i, way, min(v.block_bars, i - swept + 2))
    if block is None or v.need_gap and not day.gap(block, i - 1, way):
        return None
    entry = float(day.h[block] if way > 0 else day.l[block])
    if (day.c[i] - entry) * way <= 0:  # the retest must lie ahead
        return None
    leg = slice(max(block - day.span, 0), block + 1)
    stop = float(day.l[leg].min() - v.stop_buffer if way > 0 else day.h[leg].max() + v.stop_buffer)
    risk = abs(entry - stop)
    if not v.min_risk <= risk <= v.max_risk:
        return None
    reach = [(price - entry) * way for price, side, _ in day.pools(i) if side == way]
    target = entry + way * min((r for r in reach if r >= v.min_rr * risk and r > 0), default=v.min_rr * risk)
    return entry, stop, target, day.kind(i, way)


def _fills(day: _Day, i: int, way: int, order: tuple, until: int) -> tuple[str, int]:
    """What becomes of an order that rests from bar i on: filled, unfilled or still waiting at the day's end, and when."""
    entry, stop, target, _ = order
    for j in range(i, len(day.c)):
        if (day.l[j] if way > 0 else day.h[j]) * way <= entry * way:
            return "filled", j
        ran = day.h[j] >= target if way > 0 else day.l[j] <= target
        if ran or (day.c[j] - stop) * way < 0 or j >= until or day.minutes[j] >= SQUARE_OFF:
            return "unfilled", j
    return "waiting", len(day.c)


def _walk(day: _Day, v) -> list[tuple]:
    """(bar, event, way, pool, depth, kind, entry, stop, target, exit, status) of a session under a variant, in order."""
    out, taken, i, held = [], 0, 0, None  # held: the sweep that waits for its break
    none = (None,) * 6
    n = len(day.c)

    def look(i: int):
        found = day.sweep(i, v.min_sweep) if day.minutes[i] <= v.cutoff else None
        if found is None or v.sides not in ("both", "LONG" if found[1] > 0 else "SHORT"):
            return None
        out.append((i, "sweep", found[1], found[2], found[0], *none))
        return (i, *found, day.reference(i, found[1]))

    while i < n:
        if held is None:
            held = look(i) if taken < v.most_trades else None
            i += 1
            continue
        swept, depth, way, pool, level = held
        if (day.c[i] - level) * way > 0:
            out.append((i, "break", way, pool, depth, *none))
            order = _order(day, i, swept, way, v)
            if order:
                entry, stop, target, kind = order
                said = (way, pool, depth, kind, entry, stop, target)
                out.append((i, "armed", *said, None, None))
                fate, j = _fills(day, i + 1, way, order, i + v.entry_bars)
                held = None
                if fate != "waiting":
                    out.append((j, fate, *said, None, None))
                if fate == "filled":
                    j, price, status = day.exit(j, way, stop, target)
                    out.append((j, "trade", *said, price, status))
                    taken += 1
                i = j + 1
                continue
            held = None
        elif i >= swept + v.break_bars:
            held = None
        held = look(i) or held
        i += 1
    return out


def sweep_events(bars: DataFrame, table: DataFrame, span: int = 2, least_bars: int = 40) -> DataFrame:
    """Events of the sweep setup under the variants of table, a row each: sweep, break, armed, filled, unfilled and trade.

    A sweep waits break_bars for a close beyond its reference swing and gives way to a later one. The
    break must leave a block whose retest lies ahead and whose risk is in bounds; the order then rests
    entry_bars. It goes unfilled when price runs to the target or closes beyond the stop first. No sweep
    counts after the cutoff, none waits while a trade is open or once most_trades are done. Counts by
    event are the funnel; trades have their exit. Bars without a value, and sessions of few bars or
    after one of few, are left out. A group is one session, at most a day of bars, and goes through the
    variants inside its task; they are parameters and reach it as such.
    """
    b = with_sessions(bars.dropna(subset=["o", "h", "l", "c"]), span, least_bars)
    b = b.select("symbol", "day", "ts_ms", "o", "h", "l", "c", "minutes", "swing_high", "swing_low", "old_hi", "old_lo", "old_lc")
    given = list(grid(table).itertuples(index=False))

    def session(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        day = _Day(s.sort_values("ts_ms"), span)
        names = {1: "LONG", -1: "SHORT"}
        rows = [(*key, v.variant, day.at[e[0]], e[1], names[e[2]], *e[3:]) for v in given for e in _walk(day, v)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in EVENT.split(", ")])

    return b.groupBy("symbol", "day").applyInPandas(session, EVENT)


def funnel(events: DataFrame, cost: float = 6.0) -> DataFrame:
    """Per variant: how many sweeps broke, armed and filled, and the economics of the trades."""
    n = lambda e: F.count(F.when(F.col("event") == e, 1))
    way = F.when(F.col("direction") == "LONG", 1).otherwise(-1)
    pts = F.when(F.col("event") == "trade", (F.col("exit") - F.col("entry")) * way)
    risk = F.abs(F.col("entry") - F.col("stop"))
    e = events.withColumns({"pts": pts, "r": F.when(risk > 0, pts / risk)})
    return e.groupBy("variant").agg(
        n("sweep").alias("sweeps"), n("break").alias("breaks"), n("armed").alias("armed"), n("filled").alias("filled"), n("unfilled").alias("unfilled"),
        *(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("target", "stop", "squareoff")),
        (F.avg((F.col("pts") > 0).cast("double")) * 100).alias("win_pct"), F.avg("pts").alias("gross"), (F.avg("pts") - cost).alias("net"), F.avg("r").alias("mean_r"),
    )


def marked_pools(bars: DataFrame, span: int = 2, least: float = 0.0) -> DataFrame:
    """(symbol, day, ts_ms, side, price, taken_ms, swept, depth): each session's swings as pools, when the first later bar
    trades through them, and whether that bar closes back (swept) from at least least beyond; a pool that rests has no taken_ms.
    """
    b = swings(bars, span).withColumn("k", F.row_number().over(of_day()))
    row = lambda side, price: F.struct(F.lit(side).alias("side"), F.col(price).alias("price"))
    said = F.filter(F.array(F.when(F.col("swing_high"), row("buy", "h")), F.when(F.col("swing_low"), row("sell", "l"))), lambda x: x.isNotNull())
    pool = b.select("symbol", "day", "ts_ms", "k", F.explode(said).alias("p")).select("symbol", "day", "ts_ms", "k", "p.*")
    bar = b.select("symbol", "day", F.col("ts_ms").alias("at"), F.col("k").alias("later"), "h", "l", "c")
    buy = F.col("side") == "buy"
    through = F.when(buy, F.col("h") > F.col("price")).otherwise(F.col("l") < F.col("price"))
    met = pool.join(bar, ["symbol", "day"]).where((F.col("later") > F.col("k") + span) & through)
    first = met.groupBy("symbol", "ts_ms", "side").agg(F.min_by(F.struct("at", "h", "l", "c"), "later").alias("x"))
    p = pool.drop("k").join(first, ["symbol", "ts_ms", "side"], "left")
    depth = F.when(buy, F.col("x.h") - F.col("price")).otherwise(F.col("price") - F.col("x.l"))
    back = F.when(buy, F.col("x.c") < F.col("price")).otherwise(F.col("x.c") > F.col("price"))
    swept = F.coalesce(back & (depth >= least), F.lit(False))
    return p.select("symbol", "day", "ts_ms", "side", "price", F.col("x.at").alias("taken_ms"), swept.alias("swept"), F.when(swept, depth).alias("depth"))


MARK = "symbol string, day int, ts_ms long, direction string, level double, from_ms long, kind string, block_ms long, block_low double, block_high double, mitigated boolean"


def marked_breaks(bars: DataFrame, span: int = 2, block_bars: int = 10) -> DataFrame:
    """Closes of each session beyond its last known unused swing, each swing used once, with the block behind the break.

    A block is named by the first break that it stands behind, and mitigated if a later bar of the
    session comes back to its near edge. A group is one session.
    """
    b = swings(bars, span).withColumns({"minutes": F.lit(0), **{c: F.lit(0.0) for c in ("old_hi", "old_lo", "old_lc")}})

    def session(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("ts_ms")
        day, rows, blocks = _Day(s, span), [], set()
        waiting: dict[int, list[int]] = {-1: [], 1: []}
        for j in range(len(day.c)):
            for way, where, price in ((-1, day.bottoms, day.l), (1, day.tops, day.h)):
                k = j - span - 1
                if k >= 0 and k in where:
                    waiting[way].append(k)
                if not waiting[way] or (day.c[j] - price[waiting[way][-1]]) * way <= 0:
                    continue
                ref = waiting[way].pop()
                row = [*key, day.at[j], "LONG" if way > 0 else "SHORT", price[ref], day.at[ref], day.kind(j, way)]
                block = day.block(j, way, block_bars)
                if block is None or block in blocks:
                    rows.append([*row, None, None, None, None])
                    continue
                blocks.add(block)
                later = slice(j + 1, None)
                back = day.l[later] <= day.h[block] if way > 0 else day.h[later] >= day.l[block]
                rows.append([*row, day.at[block], day.l[block], day.h[block], bool(back.any())])
        return pd.DataFrame(rows, columns=[x.split()[0] for x in MARK.split(", ")]).astype({"block_ms": "Int64"})

    own = b.select("symbol", "day", "ts_ms", "o", "h", "l", "c", "minutes", "swing_high", "swing_low", "old_hi", "old_lo", "old_lc")
    return own.groupBy("symbol", "day").applyInPandas(session, MARK)


#: Columns of the structure features, in the order that models are fitted with; fixed values.
STRUCTURE = ("smc_sweep_agrees", "smc_sweep_age", "smc_sweep_depth_pct", "smc_break_agrees", "smc_break_age", "smc_break_choch", "smc_ob_state", "smc_pdh_dist_pct", "smc_pdl_dist_pct")


def structure_features(bars: DataFrame, span: int = 2, least: float = 2.0, block_bars: int = 10) -> DataFrame:
    """(symbol, ts_ms, STRUCTURE) of bars with an action: the day's last sweep and break so far, all by windows over the day.

    Agreement is 1 or -1 (0 for none), ages count bars since (-1 for none), distances are percents of the
    close. A break is a close beyond the last swing known before the bar, of lows before highs.
    """
    w = of_day()
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1 - span)
    known, leg = w.rowsBetween(Window.unboundedPreceding, -span), w.rowsBetween(-block_bars, -1)
    b = swings(bars, span).withColumn("k", F.row_number().over(w))
    days = b.groupBy("symbol", "day").agg(F.max("h").alias("hi"), F.min("l").alias("lo"), F.max_by("c", "ts_ms").alias("lc"))
    old = Window.partitionBy("symbol").orderBy("day")
    b = b.join(days.select("symbol", "day", *(F.lag(c).over(old).alias(f"old_{c}") for c in ("hi", "lo", "lc"))), ["symbol", "day"])
    b = b.withColumns({"top": F.when(F.col("swing_high"), F.col("h")), "bottom": F.when(F.col("swing_low"), F.col("l"))})
    turn = lambda c, rises: F.when(F.col(c).isNotNull(), F.coalesce((F.col(c) > F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))) if rises else (F.col(c) < F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))), F.lit(False)))
    b = b.withColumns({"rose": turn("top", True), "fell": turn("bottom", False), "tops": F.collect_list("top").over(before), "bottoms": F.collect_list("bottom").over(before)})
    # the deepest pool swept: of those above, the lowest that lies over the close; a short is called then
    above = lambda price: F.when((F.col("h") > price) & (F.col("c") < price) & (F.col("h") - price >= least), F.col("h") - price)
    below = lambda price: F.when((F.col("l") < price) & (F.col("c") > price) & (price - F.col("l") >= least), price - F.col("l"))
    pool = lambda depth, way, rank: F.when(depth.isNotNull(), F.struct(depth.alias("depth"), F.lit(-rank).alias("rank"), F.lit(way).alias("way"), F.col("k").alias("at")))
    found = [
        pool(above(F.col("old_hi")), -1, 0), pool(below(F.col("old_lo")), 1, 1), pool(above(F.col("old_lc")), -1, 2), pool(below(F.col("old_lc")), 1, 3),
        pool(F.array_max(F.transform("tops", above)), -1, 4), pool(F.array_max(F.transform("bottoms", below)), 1, 5),
    ]
    b = b.withColumn("sweep", F.when(F.col("k") > 1, F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))))
    low, high = F.last("bottom", ignorenulls=True).over(before), F.last("top", ignorenulls=True).over(before)
    rising = F.col("c") >= F.col("o")
    block = lambda side: F.max(F.when(side, F.struct("k", "l", "h"))).over(leg)
    choch = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(known), F.lit(False))
    b = b.withColumns({"down": F.col("c") < low, "up": F.col("c") > high, "was_rising": choch("rose"), "was_falling": choch("fell"), "up_block": block(rising), "down_block": block(~rising)})
    cut = lambda way, change, at: F.struct(F.col("k").alias("at"), F.lit(way).alias("way"), F.col(change).alias("choch"), F.col(f"{at}.l").alias("low"), F.col(f"{at}.h").alias("high"))
    b = b.withColumn("cut", F.when(F.col("down"), cut(-1, "was_rising", "up_block")).when(F.col("up"), cut(1, "was_falling", "down_block")))
    b = b.withColumns({"sweep": F.last("sweep", ignorenulls=True).over(upto), "cut": F.last("cut", ignorenulls=True).over(upto)})
    wanted = F.when(F.col("action") == "BUY", 1).when(F.col("action") == "SELL", -1)
    agrees = lambda way: F.when(F.col(way).isNotNull() & wanted.isNotNull(), F.when(F.col(way) == wanted, 1.0).otherwise(-1.0)).otherwise(0.0)
    share = lambda x: F.coalesce(F.when(F.col("c") != 0, x / F.col("c") * 100), F.lit(0.0))
    age = lambda at: F.coalesce(F.col("k") - F.col(at), F.lit(-1)).cast("double")
    held = F.col("c").between(F.col("cut.low"), F.col("cut.high"))
    values = [
        agrees("sweep.way"), age("sweep.at"), share(F.col("sweep.depth")), agrees("cut.way"), age("cut.at"), F.coalesce(F.col("cut.choch").cast("double"), F.lit(0.0)),
        F.when(held, agrees("cut.way")).otherwise(0.0), share(F.col("old_hi") - F.col("c")), share(F.col("c") - F.col("old_lo")),
    ]
    return b.where(F.col("action").isin("BUY", "SELL")).select("symbol", "ts_ms", *(v.alias(n) for v, n in zip(values, STRUCTURE)))
