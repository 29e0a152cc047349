"""Paper books over streams: offers followed live or as shadows, and the two arms of the cross, with open trades as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from candlemill.functions.market import DAY_MS, IST_MS, SQUARE_OFF
from candlemill.functions.options import measures
from candlemill.operators.grading import DAY_WINDOW_MS

YEAR_MS = 365 * DAY_MS
#: Most live positions, the pause of a direction after a close in minutes, units of a lot.
MOST_OPEN, COOLDOWN_MIN, UNITS = 2, 20, 75

ROW = (
    "symbol string, ts_ms long, what string, sid string, action string, entry double, target double, stop double, declined string, "
    "strike double, is_call boolean, bid double, ask double, iv double, expiry_ms long, h double, l double, c double"
)
CLOSED = "symbol string, sid string, kind string, declined string, action string, event string, ts_ms long, opened_ms long, exit_index double, paid double, received double, charges double, net double, points double"


def _minutes(ts_ms: int) -> int:
    return (ts_ms + IST_MS) % DAY_MS // 60_000


def charges(paid: float, received: float, units: int = UNITS) -> float:
    """Rupees of an option bought at the ask and sold at the bid: the spread is in the prices, so no slippage is added."""
    buy, sell = paid * units, received * units
    exchange, sebi = (buy + sell) * 0.0003503, (buy + sell) * 0.000001
    return 40.0 + sell * 0.001 + exchange + sebi + buy * 0.00003 + (40.0 + exchange + sebi) * 0.18


class PaperBook:
    """Open positions and last closes of one symbol; state() and the argument are the same plain dict."""

    def __init__(self, state: dict | None, rate: float, window_ms: int, min_points: float):
        self.open, self.closed = (state or {}).get("open", []), (state or {}).get("closed", {})
        self.rate, self.window_ms, self.min_points = rate, window_ms, min_points

    def state(self) -> dict:
        return {"open": self.open, "closed": self.closed}

    def offer(self, r) -> tuple[str, str, str | None]:
        """(event, kind, declined or why nothing was opened) of an offer that the policy took or declined."""
        live = [p for p in self.open if p["kind"] == "live"]
        declined = r.declined or (f"{MOST_OPEN} open" if len(live) >= MOST_OPEN else None)
        kind = "shadow" if declined else "live"
        if any(p["kind"] == kind and p["action"] == r.action for p in self.open):
            return "blocked", kind, "held"
        if r.ts_ms - self.closed.get(f"{kind}/{r.action}", -(1 << 60)) < COOLDOWN_MIN * 60_000:
            return "blocked", kind, "cooldown"
        if not r.ask > 0 or any(x != x for x in (r.entry, r.target, r.stop)):
            return "blocked", kind, "no price"
        way = 1 if r.action == "BUY" else -1
        goal = way * max(way * r.target, way * r.entry + self.min_points)
        numbers = {c: float(getattr(r, c)) for c in ("entry", "stop", "strike", "bid", "ask", "iv")}
        self.open.append({"sid": r.sid, "kind": kind, "declined": declined, "action": r.action, "way": way, "goal": goal, "from": int(r.ts_ms), "call": bool(r.is_call), "expiry": int(r.expiry_ms), "quote": None, "last": numbers["entry"], **numbers})
        return "opened", kind, declined

    def quote(self, r) -> None:
        for p in self.open:
            if p["strike"] == r.strike and p["call"] == bool(r.is_call):
                p["quote"] = float(r.bid)

    def premium(self, p: dict, index: float, ts_ms: int) -> float:
        """The newest bid of the strike, else the model's price less half the spread at entry."""
        if p["quote"]:
            return p["quote"]
        years = max((p["expiry"] - ts_ms) / YEAR_MS, 1e-6)
        theory = float(measures([index], [p["strike"]], [years], [p["iv"] or 0.12], [p["call"]], self.rate)[0][0])
        return max(theory - max((p["ask"] - p["bid"]) / 2, 0.0), 0.0)

    def bar(self, r) -> list[tuple]:
        """(position, status, index, premium) of what a bar closes: the stop before the target, expiry, square-off."""
        done, still = [], []
        for p in self.open:
            worst, best = (r.l, r.h) if p["way"] > 0 else (r.h, r.l)
            if r.ts_ms < p["from"]:
                still.append(p)
                continue
            if r.ts_ms > p["from"] + self.window_ms:
                status, index = "expired", p["last"]
            elif p["way"] * (worst - p["stop"]) <= 0:
                status, index = "stop", p["stop"]
            elif p["way"] * (best - p["goal"]) >= 0:
                status, index = "target", p["goal"]
            elif _minutes(r.ts_ms) >= SQUARE_OFF:
                status, index = "squareoff", r.c
            else:
                p["last"] = float(r.c)
                still.append(p)
                continue
            done.append((p, status, float(index), self.premium(p, float(index), int(r.ts_ms))))
            self.closed[f"{p['kind']}/{p['action']}"] = int(r.ts_ms)
        self.open = still
        return done


def paper_book(rows: DataFrame, rate: float = 0.065, window_ms: int = DAY_WINDOW_MS, min_points: float = 50.0) -> DataFrame:
    """Events of streaming ROW rows, what being offer, quote or bar: opened and blocked offers, and closed positions with their money.

    At most two live positions, one a direction in each book, none within the pause after a close; what
    the policy declined, or a full book, is followed as a shadow and never counts as live. Entry is at the
    ask, exit at the newest bid or the model's price. Rows of a batch go in order of time, bars before
    quotes before offers. The state is the few open positions and last closes, in the query's checkpoint.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        book = PaperBook(json.loads(state.get[0]) if state.exists else None, rate, window_ms, min_points)
        batch = pd.concat(frames)
        batch = batch.assign(order=batch["what"].map({"bar": 0, "quote": 1, "offer": 2})).sort_values(["ts_ms", "order"], kind="stable")
        out = []
        for r in batch.itertuples(index=False):
            if r.what == "offer":
                event, kind, why = book.offer(r)
                out.append((key[0], r.sid, kind, why, r.action, event, r.ts_ms, r.ts_ms, None, r.ask if event == "opened" else None, None, None, None, None))
            elif r.what == "quote":
                book.quote(r)
            else:
                for p, status, index, received in book.bar(r):
                    cost = charges(p["ask"], received)
                    net = (received - p["ask"]) * UNITS - cost
                    out.append((key[0], p["sid"], p["kind"], p["declined"], p["action"], status, r.ts_ms, p["from"], index, p["ask"], received, cost, net, net / UNITS))
        state.update((json.dumps(book.state()),))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in CLOSED.split(", ")])

    clean = rows.where("symbol is not null and ts_ms is not null and what in ('bar', 'quote', 'offer')")
    return clean.groupBy("symbol").applyInPandasWithState(step, CLOSED, "book string", "append", GroupStateTimeout.NoTimeout)


ARMS = ("gated", "ungated")
CROSS_EVENT = "symbol string, ts_ms long, arm string, event string, direction string, entry double, target double, stop double, exit double, reason string"


class CrossBook:
    """The average, the session's price and both arms' trade of one symbol, bar by bar."""

    def __init__(self, state: dict | None, period: int, look: int, warmup: int, stop_pts: float, min_rr: float, cutoff: int):
        self.s = state or {"ema": None, "day": None, "pv": 0.0, "v": 0.0, "k": 0, "before": None, "pending": None, "lows": [], "highs": [], "arms": dict.fromkeys(ARMS), "at": -1}
        self.k, self.look, self.warmup, self.stop_pts, self.min_rr, self.cutoff = 2 / (period + 1), look, warmup, stop_pts, min_rr, cutoff

    def _exit(self, trade: dict, bar) -> tuple[str, float] | None:
        way = trade["way"]
        worst, best = (bar.l, bar.h) if way > 0 else (bar.h, bar.l)
        if way * (worst - trade["stop"]) <= 0:
            return "stop", trade["stop"]
        if way * (best - trade["target"]) >= 0:
            return "target", trade["target"]
        return ("squareoff", float(bar.c)) if _minutes(bar.ts_ms) >= SQUARE_OFF else None

    def _manage(self, bar) -> list[tuple]:
        out = []
        for arm in ARMS:
            trade = self.s["arms"][arm]
            if trade and (done := self._exit(trade, bar)):
                self.s["arms"][arm] = None
                out.append((bar.ts_ms, arm, "closed", trade["way"], trade["entry"], trade["target"], trade["stop"], done[1], done[0]))
        return out

    def _rule(self, bar, signal: dict) -> list[tuple]:
        way, entry, out = signal["way"], float(bar.o), []
        target, stop = signal["target"], float(bar.o) - signal["way"] * self.stop_pts
        for arm in ARMS:
            why = (
                "open" if self.s["arms"][arm] else "time" if _minutes(bar.ts_ms) >= self.cutoff else "level" if (target - entry) * way <= 0
                else "reward" if arm == "gated" and abs(target - entry) < self.min_rr * self.stop_pts else None
            )
            if why is None:
                self.s["arms"][arm] = {"way": way, "entry": entry, "target": target, "stop": stop}
            out.append((bar.ts_ms, arm, "refused" if why else "opened", way, entry, target, stop, None, why))
        return out

    def bar(self, bar) -> list[tuple]:
        """(ts_ms, arm, event, way, entry, target, stop, exit, reason) of a closed bar; one not after the last is left out."""
        s = self.s
        if bar.ts_ms <= s["at"]:
            return []
        day = int((bar.ts_ms + IST_MS) // DAY_MS)
        if day != s["day"]:
            s.update(day=day, pv=0.0, v=0.0, k=0, before=None, pending=None)
        s["at"], s["k"] = int(bar.ts_ms), s["k"] + 1
        out = self._manage(bar)
        if s["pending"]:  # the cross of the bar before is ruled on once, at this bar's open
            out += [*self._rule(bar, s["pending"]), *self._manage(bar)]
            s["pending"] = None
        s["ema"] = float(bar.c) if s["ema"] is None else s["ema"] + (bar.c - s["ema"]) * self.k
        s["pv"], s["v"] = s["pv"] + (bar.h + bar.l + bar.c) / 3 * (bar.v or 0.0), s["v"] + (bar.v or 0.0)
        s["lows"], s["highs"] = [*s["lows"], float(bar.l)][-self.look :], [*s["highs"], float(bar.h)][-self.look :]
        side = s["ema"] - s["pv"] / s["v"] if s["v"] > 0 else None
        if side is not None and s["before"] is not None and s["k"] > self.warmup:
            way = 1 if s["before"] < 0 <= side else -1 if s["before"] > 0 >= side else 0
            if way:
                s["pending"] = {"way": way, "target": max(s["highs"]) if way > 0 else min(s["lows"])}
        s["before"] = side
        return out


def cross_book(bars: DataFrame, period: int = 9, look: int = 20, warmup: int = 3, stop_pts: float = 20.5, min_rr: float = 1.5, cutoff: int = 900) -> DataFrame:
    """Events of both arms of the cross over streaming closed bars(symbol, ts_ms, o, h, l, c, v): opened, refused and closed.

    The gated arm asks for the least reward to risk, the other takes every cross; an arm holds one trade.
    Each cross is ruled on once, at the open of the bar after it and after exits; the target is the extreme
    of the last bars up to the cross. The stop wins a bar that touches both, square-off ends what is open.
    A symbol's bars go in order of time, one that comes late is left out. The state is one small record a
    symbol, in the query's checkpoint, so a restart goes on where it stopped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        book = CrossBook(json.loads(state.get[0]) if state.exists else None, period, look, warmup, stop_pts, min_rr, cutoff)
        rows = [(key[0], *e[:3], "LONG" if e[3] > 0 else "SHORT", *e[4:]) for b in pd.concat(frames).sort_values("ts_ms").itertuples(index=False) for e in book.bar(b)]
        state.update((json.dumps(book.s),))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in CROSS_EVENT.split(", ")])

    clean = bars.dropna(subset=["symbol", "ts_ms", "o", "h", "l", "c"]).select("symbol", "ts_ms", "o", "h", "l", "c", "v")
    return clean.groupBy("symbol").applyInPandasWithState(step, CROSS_EVENT, "book string", "append", GroupStateTimeout.NoTimeout)
