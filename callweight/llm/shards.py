"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import Scratch, numbered, sub_buckets

SHARDS = 16


def jump_hash(key: np.ndarray, n: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key among n; from n to n+1 a key stays or goes to shard n."""
    key = key.astype(np.uint64).copy()
    b, j = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        j[live] = ((b[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[j[live] < n]
    return b


def jump_shard(key, n: int):
    """Column: shard of a long column. The key is hashed first, so consecutive ids spread; null
    keys hash like any other value."""

    @F.pandas_udf("int")
    def shard(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy(np.int64).view(np.uint64), n).astype(np.int32))

    return shard(F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard, its place in the shard and the shard it takes when one is added.

    Law `key`: id and shard count alone decide. Columns: id, size (UTF-8 bytes + 1, null text 1),
    text_crc32 (null text: null), law, shard, slot (gapless from 0 in each shard, by sub-bucket,
    id, checksum), grown_shard, and the text's own columns are not carried. Null ids form one key;
    rows alike in id and text take neighbouring slots in any order. An empty table gives no rows.
    """
    d = docs.select(
        F.col(id_col).alias(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    d = d.withColumn("shard", jump_shard(F.col(id_col), shards)).withColumn("grown_shard", jump_shard(F.col(id_col), shards + 1))
    d = Scratch(docs.sparkSession, "shards").keep(d)  # no texts from here on
    out = numbered(d, ["shard"], [id_col, "text_crc32", "size"], key=F.struct(id_col, "text_crc32"), parts=sub_buckets(d), name="slot")
    return out.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """All columns of every row plus `shard`, which replaces a column of that name."""
    return docs.withColumn("shard", jump_shard(F.col(id_col), shards))
