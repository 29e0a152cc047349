"""A bit set of 64-bit keys, of fixed width, that tasks get by broadcast: it may hold more than was put in, never less."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a set unless told otherwise, 8 MB, and words of 64 bits that one row carries to the driver.
BITS, ROW_WORDS = 1 << 26, 1 << 12


def _block(words: pa.Table) -> pa.Table:
    own = np.zeros(ROW_WORDS, np.int64)
    at = words.column("at").to_numpy()
    own[at % ROW_WORDS] = words.column("bits").to_numpy()
    return pa.table({"block": pa.array([int(at[0]) // ROW_WORDS], pa.int64()), "words": pa.array([own.tobytes()], pa.binary())})


def bit_set(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Words of the set of keys(key long); bits is a power of two. No more than the set itself reaches the driver."""
    slot = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = words.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    blocks = words.groupBy(F.expr(f"at div {ROW_WORDS}").alias("block")).applyInArrow(_block, "block long, words binary")
    out = np.zeros(-(-bits // (64 * ROW_WORDS)) * ROW_WORDS, np.int64)
    for block, own in blocks.collect():
        out[block * ROW_WORDS : (block + 1) * ROW_WORDS] = np.frombuffer(own, np.int64)
    return out[: bits // 64].view(np.uint64)


def has(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys may be in the set."""
    slot = (key.view(np.uint64) >> np.uint64(6)) & np.uint64(len(words) * 64 - 1)
    return words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) != 0
