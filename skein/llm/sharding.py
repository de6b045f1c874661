"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key walks a pseudo-random chain of ever larger bucket numbers and stays at the last one below the
shard count, so there is no ring table, shard counts are even, and adding a shard at the end moves
just the 1/(n+1) of the keys whose chain reaches it.

Cases: a null key counts as one fixed key; repeated keys share a shard and get slots of their own;
equal rows get equal columns but for the slot; a null or empty text has size 8, a text of any length that of its bytes; of rows whose
keys mix alike the one of least id, size and checksum comes first; an empty table stays empty; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import fresh_name
from skein.plans.numbering import numbered

#: Key of a row whose key is null.
NULL_KEY = 0x6E756C6C


def mix64(keys: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, so that consecutive ids start unrelated chains."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key, all chains advanced together until each passes ``buckets``."""
    if buckets < 1:
        raise ValueError("at least one shard is needed")
    state, at, ahead = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while live.size:
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < buckets]
    return at


def key_column(df: DataFrame, key: str) -> Column:
    """Integral keys count as they are, others by their hash."""
    kind = df.schema[key].dataType
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    plain = F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))
    return F.coalesce(plain, F.lit(NULL_KEY))


def place(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard, ord): the shard among ``shards`` and ``shards + 1``, and 63 mixed bits of the key."""

    @F.pandas_udf("shard int, grown_shard int, ord long")
    def placed(keys: pd.Series) -> pd.DataFrame:
        mixed = mix64(keys.to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": jump(mixed, shards).astype(np.int32), "grown_shard": jump(mixed, shards + 1).astype(np.int32), "ord": (mixed >> np.uint64(1)).astype(np.int64)})

    return placed(key)


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard`` (with one shard more): one map, no shuffle."""
    p = fresh_name(df, "placed")
    return df.withColumn(p, place(key_column(df, key), shards)).withColumns({"shard": F.col(p)["shard"], "grown_shard": F.col(p)["grown_shard"]}).drop(p)


def shard_slots(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, size, checksum and a gapless slot for every row, in the order of the mixed key.

    A shard, and a key (null, say), may hold far more rows than a task should, so rows are dealt by ranges of their whole order,
    counted by range and shard, and numbered side by side.
    """
    k = F.col("key")
    rows = (
        df.select(key_column(df, key).alias("key"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
        .select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), place(k, shards).alias("p"))
        .select("doc_id", "size", "text_crc32", "p.*")
    )
    order = ["ord", "doc_id", "size", "text_crc32"]
    return numbered(rows, ["shard"], order, "slot").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
