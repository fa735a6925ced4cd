"""SipHash-1-3 with a zero key of (u32 task, u32 row, u64 seed), the hash that assigns splits.

Written from the published algorithm (Aumasson and Bernstein, 2012), over whole columns of 64-bit words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: "somepseudorandomlygeneratedbytes" as four big-endian words, fixed by the algorithm.
INITIAL = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    a, c = a + b, c + d
    b, d = _turn(b, 13) ^ a, _turn(d, 16) ^ c
    a, c = _turn(a, 32) + d, c + b
    return a, _turn(b, 17) ^ c, _turn(c, 32), _turn(d, 21) ^ a


def siphash13(task: np.ndarray, row: np.ndarray, seed: np.ndarray) -> np.ndarray:
    task, row, seed = (np.asarray(x).astype(np.uint64) for x in (task, row, seed))
    state = tuple(np.full(np.broadcast(task, row, seed).shape, x, np.uint64) for x in INITIAL)
    for word in (task | (row << np.uint64(32)), seed, np.full(1, 16 << 56, np.uint64)):
        a, b, c, d = state
        a, b, c, d = _round(a, b, c, d ^ word)
        state = a ^ word, b, c, d
    a, b, c, d = state
    c = c ^ np.uint64(0xFF)
    for _ in range(3):
        a, b, c, d = _round(a, b, c, d)
    return a ^ b ^ c ^ d


def bucket(task: Column, row: Column, seed: int, n: int = 1000) -> Column:
    """hash % n, in 0 to n - 1."""

    @F.pandas_udf("int")
    def run(t: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series((siphash13(t.to_numpy(), r.to_numpy(), np.full(1, seed, np.uint64)) % np.uint64(n)).astype(np.int32))

    return run(task, row)
