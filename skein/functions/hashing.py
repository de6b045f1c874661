"""Hashes with unsigned 64-bit wrap-around, which Spark's checked arithmetic lacks; Arrow batches of numpy words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_U = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    z = x + _U(0x9E3779B97F4A7C15)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def splitmix64(value: Column) -> Column:
    """The splitmix64 step of a long, as a signed long; null stays null."""

    @F.pandas_udf("long")
    def mixed(x: pd.Series) -> pd.Series:
        there = x.notna()
        out = pd.Series([None] * len(x), dtype="Int64", index=x.index)
        out[there] = _splitmix(x[there].astype("int64").to_numpy().view(_U)).view(np.int64)
        return out

    return mixed(value)


def fnv1a(values: Column) -> Column:
    """FNV-1a over the eight bytes, least first, of each long of an array, as a signed long."""

    @F.pandas_udf("long")
    def hashed(rows: pd.Series) -> pd.Series:
        def one(row: np.ndarray) -> int:
            h = 0xCBF29CE484222325
            for b in np.asarray(row, np.int64).tobytes():
                h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
            return h - (1 << 64) if h >> 63 else h

        return rows.map(one)

    return hashed(values)
