"""Sharding by jump consistent hashing: a stable key and the shard count alone decide a row's shard.

No ring table is kept. With n+1 shards in place of n, a row either stays or goes to the new shard, and about 1/(n+1) of
the rows go. Law `key`: equal ids share a shard; texts don't matter, so equal texts under different ids may lie apart.

Each row also gets a slot in its shard, gapless from 0. Slots are counted in lanes (hash of the id and text hash, about
LANE_ROWS rows each, as many as the input needs) and a lane's start is the running sum of the lanes before it, so no
shard is ever gathered in one task. Only ids, sizes and hashes move, never texts.

Defined cases: a null text has size 1 and the crc32 of no bytes (0). A null id is hashed as the key 0. Repeated rows
get the same shard and slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.common import groups_for

LANE_ROWS = 200_000


def mixed(keys: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that runs of ids become unrelated keys."""
    with np.errstate(over="ignore"):
        k = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        k = (k ^ (k >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        k = (k ^ (k >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return k ^ (k >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned key, all keys jumping at once until each has passed the last shard."""
    key = keys.astype(np.uint64).copy()
    at, to = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = to[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            to[live] = ((at[live] + 1) * step).astype(np.int64)
            live = live[to[live] < shards]
    return at.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Column of shards for a column of integer keys, in Arrow batches."""

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mixed(ids.to_numpy(np.int64)), shards))

    return shard(F.coalesce(key.cast("long"), F.lit(0)))


def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lane_rows: int = LANE_ROWS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard (the shard if one more were added), a row for each row of df."""
    rows = df.select(
        df[id_col].alias("__id"),
        (F.coalesce(F.octet_length(df[text_col]), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(df[text_col], F.lit("")).cast("binary")).alias("text_crc32"),
    )
    lanes = groups_for(df.count(), lane_rows)
    placed = rows.withColumns({
        "shard": jump_shard(F.col("__id"), shards),
        "grown_shard": jump_shard(F.col("__id"), shards + 1),
        "__lane": F.pmod(F.xxhash64("__id", "text_crc32"), F.lit(lanes)).cast("int"),
    })
    in_lane = Window.partitionBy("shard", "__lane").orderBy("__id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "__lane").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("shard", "__lane", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = placed.withColumn("__row", F.row_number().over(in_lane) - 1)
    return numbered.join(starts.hint("merge"), ["shard", "__lane"]).select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__start") + F.col("__row")).cast("long").alias("slot"), "grown_shard",
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 8)
