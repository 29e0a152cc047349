"""Cuts between a feature's values for trees over binned features: shares of all values, exact, without a task that holds a column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BINS, TOP = 63, np.uint64(1 << 63)
#: Bits of a value that each pass over the rows reads, where tasks count for few columns and for many.
FEW, MANY, FEW_COLUMNS = (16, 12, 12, 12, 12), (8,) * 8, 32
#: Rows that a task goes through at once.
AT_ONCE = 65_536


def _between(values: np.ndarray) -> np.ndarray:
    return (values[1:] + values[:-1]) / 2


def edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between a feature's values, each seen value or each bins-th share of them."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)))
    return _between(values)


def _keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values x."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u & TOP, ~u, u | TOP)


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & TOP, keys ^ TOP, ~keys).view(float)


def _shares(n: int, bins: int):
    """Ranks below and above each share of n values, and how far the share lies between them."""
    at = (n - 1) * np.linspace(0, 1, bins + 1)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, n - 1), at - low


def together(frames: Iterator[pd.DataFrame], rows: int = AT_ONCE) -> Iterator[pd.DataFrame]:
    """The same rows in fewer frames, of so many rows at least but for the last."""
    held = []
    for f in frames:
        held.append(f)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def _counting(cells: dict, columns: dict[int, str], blocks: int, bins: int, bits: int, after: int):
    """Counts the next bits of the values that begin with one of the cells, with `after` bits behind them; the first time also up to bins + 1 of the values."""
    first, mask = bits + after == 64, np.uint64((1 << bits) - 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seen = {}, {}
        for f in together(frames):
            before = [f["fold"].to_numpy() < of for of in range(blocks)]
            for j, c in columns.items():
                x = f[c].to_numpy(float) + 0.0
                keys = _keys(x) >> np.uint64(after)
                upper, digit = keys >> np.uint64(bits), (keys & mask).astype(np.int64)
                for of, own in enumerate(before):
                    k = (of, j)
                    if k not in cells or not own.any():
                        continue
                    at = np.minimum(np.searchsorted(cells[k], upper[own]), len(cells[k]) - 1)
                    hit = cells[k][at] == upper[own]
                    if k not in held:
                        held[k] = np.zeros(len(cells[k]) << bits, np.int64)
                    held[k] += np.bincount((at[hit] << bits) + digit[own][hit], minlength=len(held[k]))
                    if first and len(seen.get(k, ())) <= bins:
                        seen[k] = np.unique(np.concatenate([seen.get(k, x[:0]), pd.unique(x[own])]))[: bins + 1]
        for k, n in held.items():  # most of the counts are 0
            at = np.flatnonzero(n)
            yield pd.DataFrame([(*k, at.tobytes(), n[at].tobytes(), seen.get(k, np.zeros(0)).tobytes())], columns=["of", "j", "at", "n", "seen"])

    return run


def _finding(cells: dict, ranks: dict, bins: int, bits: int):
    """Adds up the counts of one column of one past: its size, and for each rank the cell that it lies in and its place there."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        k = (int(key[0]), int(key[1]))
        counts = np.zeros(len(cells[k]) << bits, np.int64)
        for at, n in zip(part["at"], part["n"]):
            counts[np.frombuffer(at, np.int64)] += np.frombuffer(n, np.int64)
        n, seen = int(counts.sum()), np.unique(np.concatenate([np.frombuffer(b) for b in part["seen"]]))
        if not ranks:
            left = np.unique(np.concatenate(_shares(n, bins)[:2]))
            at = np.zeros(len(left), np.int64)
        else:
            at, left = ranks[k]
        upto = np.cumsum(counts.reshape(-1, 1 << bits), axis=1)
        digit = np.array([np.searchsorted(upto[c], r, side="right") for c, r in zip(at, left)], np.int64)
        left = left - np.where(digit > 0, upto[at, np.maximum(digit - 1, 0)], 0)
        found = (cells[k][at] << np.uint64(bits)) | digit.astype(np.uint64)
        return pd.DataFrame([(*k, n, found.tobytes(), left.astype(np.int64).tobytes(), seen.tobytes())], columns=["of", "j", "n", "found", "left", "seen"])

    return run


def past_edges(given: DataFrame, columns: list[str], blocks: int, bins: int = BINS, only: tuple[int, ...] | None = None) -> dict[int, list[np.ndarray]]:
    """The cuts that edges() gives of each column over the rows of given(fold, columns) before each of the folds, or of those named; folds without a row before them have none.

    A rank is found some of the values' bits at a time: a pass counts the next bits of the values that begin with those found so far. Tasks hold
    counts, some thousands a rank at most, and no rows, and the cuts do not hang on how rows are dealt. Columns must have no null and no NaN.
    """
    cells = {(of, j): np.zeros(1, np.uint64) for of in (range(blocks) if only is None else only) for j in range(len(columns))}
    ranks, sizes, out = {}, {}, {}
    widths = FEW if len(cells) <= FEW_COLUMNS else MANY
    for depth, bits in enumerate(widths):
        left = {j: columns[j] for j in sorted({j for _, j in cells})}
        counted = given.select("fold", *left.values()).mapInPandas(_counting(cells, left, blocks, bins, bits, 64 - sum(widths[: depth + 1])), "of int, j int, at binary, n binary, seen binary")
        found = counted.groupBy("of", "j").applyInPandas(_finding(cells, ranks, bins, bits), "of int, j int, n long, found binary, left binary, seen binary").collect()
        cells, ranks = {}, {}
        for r in found:
            k, keys, seen = (r["of"], r["j"]), np.frombuffer(r["found"], np.uint64), np.frombuffer(r["seen"])
            sizes.setdefault(k, r["n"])
            if depth == 0 and len(seen) <= bins:
                out[k] = _between(seen)
                continue
            cells[k], at = np.unique(keys, return_inverse=True)
            ranks[k] = (at, np.frombuffer(r["left"], np.int64))
            if depth == len(widths) - 1:
                out[k] = _between(_at_shares(_values(keys), sizes[k], bins))
        if not cells:
            break
    return {of: [out[of, j] for j in range(len(columns))] for of in sorted({k[0] for k in out})}


def _at_shares(values: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The distinct values at the shares, as numpy's quantile puts them between two ranks; values are those of all ranks that _shares names, in order."""
    low, high, part = _shares(n, bins)
    ranks = np.unique(np.concatenate([low, high]))
    a, b = values[np.searchsorted(ranks, low)], values[np.searchsorted(ranks, high)]
    return np.unique(np.where(part >= 0.5, b - (b - a) * (1 - part), a + (b - a) * part))
