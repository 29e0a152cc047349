"""Grading and the paper books by event time: what is open ends when its time is over, with or without a further bar."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame

from candlemill.functions.market import DAY_MS, IST_MS, SQUARE_OFF
from candlemill.functions.options import implied, measures
from candlemill.operators.grading import DAY_WINDOW_MS
from candlemill.streaming import books, grading
from candlemill.streaming.books import ARMS, COOLDOWN_MIN, CROSS_EVENT, UNITS, YEAR_MS, CrossBook, PaperBook, charges
from candlemill.streaming.ordered import follow

#: No entry from this minute of the day on, the deltas that a strike may have, a lot's tick.
NO_ENTRY_AFTER, DELTA_BAND, TICK = 900, (0.35, 0.70), 0.05
#: How long a quote is taken for the market's.
QUOTE_MS = 5 * 60_000
MINUTE = 60_000


def square_off(ts_ms: int) -> int:
    """The square-off of the day of an instant."""
    return (ts_ms + IST_MS) // DAY_MS * DAY_MS - IST_MS + SQUARE_OFF * MINUTE


class Grader:
    """Open signals of a symbol; an open one expires when its window is over, at the last close seen."""

    def __init__(self, state, window_ms: int, min_points: float):
        self.open, self.window_ms, self.min_points = state or [], window_ms, min_points

    def state(self):
        return self.open or None

    def next_time(self):
        return min((s["from"] for s in self.open), default=None) + self.window_ms + 1 if self.open else None

    def _out(self, s: dict, status: str, price: float) -> tuple:
        return s["sid"], status, price, s["at"], s["up"], s["down"]

    def due(self, t: int) -> list:
        over = [s for s in self.open if s["from"] + self.window_ms < t]
        self.open = [s for s in self.open if s["from"] + self.window_ms >= t]
        return [self._out(s, "expired", s["last"]) for s in over]

    def row(self, r: tuple) -> list:
        ts, sid, action, entry, target, stop, h, l, c = r  # noqa: E741
        if sid is not None:
            if None in (entry, target, stop) or action not in ("BUY", "SELL"):
                return []
            way = 1 if action == "BUY" else -1
            goal = way * max(way * target, way * entry + self.min_points)
            self.open.append({"sid": sid, "from": ts, "way": way, "entry": entry, "goal": goal, "stop": stop, "up": 0.0, "down": 0.0, "at": ts, "last": entry})
            return []
        said, still = [], []
        for s in self.open:
            best, worst = (h, l) if s["way"] > 0 else (l, h)
            s["up"], s["down"] = max(s["up"], s["way"] * (best - s["entry"])), min(s["down"], s["way"] * (worst - s["entry"]))
            s["at"], s["last"] = ts, c
            if s["way"] * (worst - s["stop"]) <= 0:
                said.append(self._out(s, "stop", s["stop"]))
            elif s["way"] * (best - s["goal"]) >= 0:
                said.append(self._out(s, "target", s["goal"]))
            else:
                still.append(s)
        self.open = still
        return said


def grade_timed(rows: DataFrame, window_ms: int = DAY_WINDOW_MS, min_points: float = 0.0, late: str = "10 minutes") -> DataFrame:
    """Outcomes of grading.feed() rows, one a signal: those of the batch grading, expiry included.

    A signal without a further bar expires when the watermark passes its window. State is the open
    signals and the rows that the watermark has not passed; a symbol without either has none. Signals
    without levels or of an unknown action give nothing; bars need h, l and c.
    """
    columns = "ts_ms long, sid string, action string, entry double, target double, stop double, h double, l double, c double"
    clean = rows.where("sid is not null or (h is not null and l is not null and c is not null)")
    return follow(clean, lambda s: Grader(s, window_ms, min_points), columns, grading.OUT, lambda r: (r[1] is None, r[1] or ""), late)


class TimedPaperBook(PaperBook):
    """The paper book with the day's entry times, strikes chosen from the quotes of the moment, and times that come due.

    An offer without a strike takes, of the side it wants, the strike whose round trip costs least in
    points of the index among those quoted of late, traded and of a delta in the band. Deltas are by
    the forward of put-call parity, else the last index. An open position ends at square-off or at its
    window's end, at the last index, whether or not a bar comes.
    """

    def __init__(self, state, rate: float, window_ms: int, min_points: float):
        super().__init__(state, rate, window_ms, min_points)
        self.quotes, self.index = {tuple(k): v for k, v in (state or {}).get("quotes", [])}, (state or {}).get("index")

    def state(self):
        if not self.open and not self.closed and not self.quotes:
            return None
        return {**super().state(), "quotes": list(self.quotes.items()), "index": self.index}

    def _ends(self, p: dict) -> int:
        return min(square_off(p["from"]), p["from"] + self.window_ms + 1)

    def next_time(self):
        times = [self._ends(p) for p in self.open]
        times += [at + COOLDOWN_MIN * MINUTE for at in self.closed.values()] + [q["at"] + QUOTE_MS + 1 for q in self.quotes.values()]
        return min(times, default=None)

    def due(self, t: int) -> list:
        over = [p for p in self.open if self._ends(p) <= t]
        self.open = [p for p in self.open if self._ends(p) > t]
        said = []
        for p in over:
            status = "squareoff" if square_off(p["from"]) <= t else "expired"
            self.closed[f"{p['kind']}/{p['action']}"] = t
            said.append(self._closed(p, status, p["last"], self.premium(p, p["last"], t), t))
        # pauses that are over and quotes that are stale are forgotten
        self.closed = {k: at for k, at in self.closed.items() if at + COOLDOWN_MIN * MINUTE > t}
        self.quotes = {k: q for k, q in self.quotes.items() if q["at"] + QUOTE_MS >= t}
        return said

    @staticmethod
    def _closed(p: dict, status: str, index: float, received: float, ts: int) -> tuple:
        cost = charges(p["ask"], received)
        net = (received - p["ask"]) * UNITS - cost
        return p["sid"], p["kind"], p["declined"], p["action"], status, ts, p["from"], index, p["ask"], received, cost, net, net / UNITS

    def choose(self, call: bool, ts: int) -> dict | None:
        """The quote to buy, with its strike and volatility; of equals the lower strike."""
        live = {k: q for k, q in self.quotes.items() if q["bid"] > 0 and q["ask"] >= q["bid"] and q["expiry"] > ts}
        if not live:
            return None
        expiry = min(q["expiry"] for q in live.values())
        live = {k: q for k, q in live.items() if q["expiry"] == expiry}
        years = (expiry - ts) / YEAR_MS
        mid = {k: (q["bid"] + q["ask"]) / 2 for k, q in live.items()}
        both = [k + (mid[k, True] - mid[k, False]) * np.exp(self.rate * years) for k, side in live if side and (k, False) in live]
        forward = float(np.median(both)) if both else self.index
        side = sorted(k for k, c in live if c == call)
        if forward is None or not side:
            return None
        n = len(side)
        arrays = [np.array([mid[k, call] for k in side]), np.full(n, forward), np.array(side, float), np.full(n, years), np.full(n, call)]
        vols = implied(*arrays, self.rate)
        deltas = measures(arrays[1], arrays[2], arrays[3], np.nan_to_num(vols), arrays[4], self.rate)[1]
        best = None
        for k, vol, delta in zip(side, vols, deltas):
            q = live[k, call]
            if vol == vol and DELTA_BAND[0] <= delta <= DELTA_BAND[1] and q["volume"] > 0:
                points = (charges(mid[k, call], mid[k, call]) / UNITS + q["ask"] - q["bid"]) / delta
                if best is None or points < best[0]:
                    best = (points, {"strike": float(k), "bid": q["bid"], "ask": q["ask"], "iv": float(vol), "expiry_ms": expiry})
        return best[1] if best else None

    def row(self, r: tuple) -> list:
        r = SimpleNamespace(**dict(zip(PAPER_NAMES, r)))
        if r.what == "quote":
            if r.strike is not None and r.is_call is not None and r.bid is not None:
                self.quote(r)
                if r.ask is not None and r.expiry_ms is not None:
                    self.quotes[r.strike, bool(r.is_call)] = {"bid": r.bid, "ask": r.ask, "volume": r.volume or 0.0, "expiry": r.expiry_ms, "at": r.ts_ms}
            return []
        if r.what == "bar":
            if None in (r.h, r.l, r.c):
                return []
            self.index = r.c
            return [self._closed(p, status, index, received, r.ts_ms) for p, status, index, received in self.bar(r)]
        minute = books._minutes(r.ts_ms)
        why = "past square-off" if minute >= SQUARE_OFF else "too late" if minute >= NO_ENTRY_AFTER else None
        if why is None and None in (r.entry, r.target, r.stop):
            why = "no price"
        if why is None and r.strike is None:
            r.is_call = r.action == "BUY"
            pick = self.choose(r.is_call, r.ts_ms)
            why = None if pick else "no strike"
            r.__dict__.update(pick or {})
        if why is None and None in (r.bid, r.ask, r.iv, r.expiry_ms):
            why = "no price"
        if why:
            return [(r.sid, "shadow" if r.declined else "live", why, r.action, "blocked", r.ts_ms, r.ts_ms, *[None] * 6)]
        event, kind, why = self.offer(r)
        return [(r.sid, kind, why, r.action, event, r.ts_ms, r.ts_ms, None, r.ask if event == "opened" else None, *[None] * 4)]


PAPER = (
    "ts_ms long, what string, sid string, action string, entry double, target double, stop double, declined string, strike double, is_call boolean, "
    "bid double, ask double, iv double, expiry_ms long, volume double, h double, l double, c double"
)
PAPER_NAMES = [c.split()[0] for c in PAPER.split(", ")]


def paper_timed(rows: DataFrame, rate: float = 0.065, window_ms: int = DAY_WINDOW_MS, min_points: float = 50.0, late: str = "10 minutes") -> DataFrame:
    """Events of rows(symbol, PAPER), as those of books.paper_book, by event time.

    Rows of one time go bars first, then quotes, then offers. Offers from 15:00 on and after square-off
    are blocked; one without a strike gets it from the quotes. However rows arrive within the watermark's
    delay, the events are those of the rows in order. Quotes go stale and pauses end by timers, so
    a symbol that falls silent keeps no state.
    """
    order = {"bar": 0, "quote": 1, "offer": 2}
    clean = rows.where("what in ('bar', 'quote', 'offer')")
    return follow(clean, lambda s: TimedPaperBook(s, rate, window_ms, min_points), PAPER, books.CLOSED, lambda r: (order[r[1]], r[2] or "", r[8] or 0.0, bool(r[9])), late)


class TimedCrossBook(CrossBook):
    """The cross book whose trades end at square-off, at the last close, also where no bar comes then.

    With fill_bar the target is the extreme of the last bars up to the one that fills, as a live book sees
    them when it rules; else up to the cross, as the replay's.
    """

    def __init__(self, state, fill_bar: bool, *given):
        super().__init__(state, *given)
        self.fill_bar = fill_bar
        self.s.setdefault("last", None)

    def _rule(self, bar, signal: dict) -> list[tuple]:
        if self.fill_bar:
            seen = [*self.s["highs"], float(bar.h)] if signal["way"] > 0 else [*self.s["lows"], float(bar.l)]
            signal = {**signal, "target": (max if signal["way"] > 0 else min)(seen[-self.look :])}
        return super()._rule(bar, signal)

    def state(self):
        return self.s

    def next_time(self):
        # a day's trades and its waiting cross end with the day
        return square_off(self.s["at"]) if (any(self.s["arms"].values()) or self.s["pending"]) and self.s["at"] < square_off(self.s["at"]) else None

    def due(self, t: int) -> list:
        said = []
        for arm in ARMS:
            trade = self.s["arms"][arm]
            if trade:
                said.append((t, arm, "closed", trade["way"], trade["entry"], trade["target"], trade["stop"], self.s["last"], "squareoff"))
                self.s["arms"][arm] = None
        self.s["pending"], self.s["at"] = None, max(self.s["at"], t - 1)
        return self._named(said)

    def row(self, r: tuple) -> list:
        said = self.bar(SimpleNamespace(**dict(zip(("ts_ms", "o", "h", "l", "c", "v"), r))))
        self.s["last"] = r[4]
        return self._named(said)

    @staticmethod
    def _named(said: list) -> list:
        return [(*e[:3], "LONG" if e[3] > 0 else "SHORT", *e[4:]) for e in said]


def cross_timed(bars: DataFrame, period: int = 9, look: int = 20, warmup: int = 3, stop_pts: float = 20.5, min_rr: float = 1.5, cutoff: int = 900, fill_bar: bool = True, late: str = "10 minutes") -> DataFrame:
    """Events of books.cross_book by event time: bars in order however they arrive, trades closed at square-off without a bar, targets that see the bar of the fill (fill_bar) or not."""
    clean = bars.dropna(subset=["symbol", "ts_ms", "o", "h", "l", "c"])
    return follow(clean, lambda s: TimedCrossBook(s, fill_bar, period, look, warmup, stop_pts, min_rr, cutoff), "ts_ms long, o double, h double, l double, c double, v double", CROSS_EVENT, lambda r: r[1:5], late)
