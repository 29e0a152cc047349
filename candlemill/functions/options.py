"""Black-76 prices, deltas, daily decay and implied volatility, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# Coefficients of Cody's rational approximations of the error function (Math. Comp. 23, 1969); fixed values.
_A = (3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3, 1.85777706184603153e-1)
_B = (2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_C = (5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3, 2.15311535474403846e-8)
_D = (1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(z: np.ndarray, over: tuple, under: tuple) -> np.ndarray:
    """Quotient of two polynomials; over's last coefficient leads, under's leading one is 1."""
    a, b = over[-1] * z, z
    for p, q in zip(over[:-2], under[:-1]):
        a, b = (a + p) * z, (b + q) * z
    return (a + over[-2]) / (b + under[-1])


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of an array, right to about 1e-13 of its value."""
    x = np.asarray(x, dtype=float)
    y = np.abs(x)
    near, far = np.minimum(y, 0.46875), np.maximum(y, 4.0)
    mid, z = np.clip(y, 0.46875, 4.0), 1 / (far * far)
    tail = np.exp(-far * far) * (1 / math.sqrt(math.pi) - z * _ratio(z, _P, _Q)) / far
    out = np.where(y <= 0.46875, 1 - near * _ratio(near * near, _A, _B), np.where(y <= 4.0, np.exp(-mid * mid) * _ratio(mid, _C, _D), tail))
    return np.where(x < 0, 2 - out, out)


def phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(x, dtype=float) / math.sqrt(2))


def measures(f, k, t, vol, call, rate: float):
    """(price, unsigned delta, decay a day) of arrays; the intrinsic value where nothing is left to move."""
    f, k, t, vol = (np.asarray(x, dtype=float) for x in (f, k, t, vol))
    call = np.asarray(call, dtype=bool)
    live = (t > 0) & (vol > 0) & (f > 0) & (k > 0)
    F_, K_, T_, V_ = (np.where(live, x, 1.0) for x in (f, k, t, vol))
    root = V_ * np.sqrt(T_)
    d1 = (np.log(F_ / K_) + 0.5 * V_ * V_ * T_) / root
    off = np.exp(-rate * T_)
    s = np.where(call, 1.0, -1.0)
    value, inside = np.maximum(0.0, s * (f - k)), (s * (f - k) > 0).astype(float)
    price = np.where(live, off * s * (F_ * phi(s * d1) - K_ * phi(s * (d1 - root))), value)
    delta = np.where(live, off * phi(s * d1), inside)
    decay = np.where(live, F_ * np.exp(-0.5 * d1 * d1) / math.sqrt(2 * math.pi) * V_ / (2 * np.sqrt(T_)) / 365.0, 0.0)
    return price, delta, decay


def black76(rate: float):
    """Column function (forward, strike, years, vol, is_call) to struct(price, delta, theta)."""

    @F.pandas_udf("price double, delta double, theta double")
    def price(f: pd.Series, k: pd.Series, t: pd.Series, vol: pd.Series, call: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("price", "delta", "theta"), measures(f, k, t, vol, call.fillna(False), rate))))

    return price


def implied(p, f, k, t, call, rate: float) -> np.ndarray:
    """Volatility of premiums; nan at or below intrinsic or beyond 500 %.

    Newton's steps from the price's point of inflection, within a bracket that halves where a step leaves it;
    only what still moves is priced again, so a premium costs about seven prices.
    """
    least = np.maximum(0.0, np.where(call, f - k, k - f)) * np.exp(-rate * t)
    ok = (p > 0) & (t > 0) & (p > least) & (measures(f, k, t, np.full(len(p), 5.0), call, rate)[0] >= p)
    out, at = np.full(len(p), np.nan), np.flatnonzero(ok)
    p, f, k, t, call = (x[at] for x in (p, f, k, t, call))
    low, high = np.full(len(at), 1e-4), np.full(len(at), 5.0)
    with np.errstate(all="ignore"):
        vol = np.fmax(np.sqrt(2 * np.abs(np.log(f / k)) / t), p / f * np.exp(rate * t) * np.sqrt(2 * math.pi / t))
    vol = np.where((vol > low) & (vol < high), vol, 1.0)
    for _ in range(80):
        if not len(at):
            break
        price, _, decay = measures(f, k, t, vol, call, rate)
        under = price < p
        low, high = np.where(under, vol, low), np.where(under, high, vol)
        with np.errstate(all="ignore"):
            step = vol + (p - price) / (decay * 730 * t / vol * np.exp(-rate * t))  # decay holds the price's slope in the volatility
        step = np.where((step >= low) & (step <= high), step, (low + high) / 2)
        out[at] = step
        moves = np.abs(step - vol) > 1e-14
        at, p, f, k, t, call, low, high, vol = (x[moves] for x in (at, p, f, k, t, call, low, high, step))
    return out


def implied_vol(rate: float):
    """Column function (premium, forward, strike, years, is_call) to the volatility; null at or below intrinsic or beyond 500 %."""

    @F.pandas_udf("double")
    def solve(p: pd.Series, f: pd.Series, k: pd.Series, t: pd.Series, call: pd.Series) -> pd.Series:
        p, f, k, t = (x.to_numpy(dtype=float) for x in (p, f, k, t))
        return pd.Series(implied(p, f, k, t, call.fillna(False).to_numpy(dtype=bool), rate)).replace({np.nan: None}).astype("Float64")

    return solve


def chain_measures(rate: float):
    """Column function (premium, forward, strike, years, is_call) to struct(iv, delta, theta), iv null as in implied_vol; evaluated once, also where a filter reads it."""

    @F.pandas_udf("iv double, delta double, theta double")
    def solve(p: pd.Series, f: pd.Series, k: pd.Series, t: pd.Series, call: pd.Series) -> pd.DataFrame:
        p, f, k, t = (x.to_numpy(dtype=float) for x in (p, f, k, t))
        call = call.fillna(False).to_numpy(dtype=bool)
        iv = implied(p, f, k, t, call, rate)
        _, delta, theta = measures(f, k, t, iv, call, rate)
        return pd.DataFrame({"iv": pd.Series(iv).replace({np.nan: None}).astype("Float64"), "delta": delta, "theta": theta})

    return solve.asNondeterministic()
