"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, over a thousand slots for each of the shards below.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(48))
#: Tables up to this many slots are broadcast (16 bytes a slot); larger ones are joined by a shuffle.
BROADCAST_SLOTS = 1_000_003


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard.

    Each shard prefers the slots in the order (offset + j * skip) mod `size`, offset and skip taken from
    a hash of its name. Shards claim in turns, in name order, each the first slot it prefers that is still free.
    """
    if not shards or len(set(shards)) < len(shards) or size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("shard names must differ, and the table size must be a prime not below their number")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digests]
    owner, free = [-1] * size, size
    while free:
        for i in order[:free]:
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            free -= 1
    return owner


def slot_of(key: Column, size: int) -> Column:
    """A slot for a key: the first 60 bits of the MD5 of its text form, modulo `size`. Null counts as the empty string."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size))


def table_frame(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    owner = ",".join(map(str, lookup_table(shards, size)))
    names = F.array(*(F.lit(x) for x in shards))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(owner), ",")).alias("slot", "i"))
    return table.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("i").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """`df` with the columns `slot` and `shard`; columns of these names in `df` are replaced.

    Every row is placed and none moves: with a broadcast table the plan has no shuffle. Equal keys share a
    shard, so do null keys; repeated rows stay. An empty table gives an empty result. When a shard is added or
    removed, about its share of the slots changes hands.
    """
    table = table_frame(df.sparkSession, shards, size)
    if size <= BROADCAST_SLOTS:
        table = F.broadcast(table)
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size))
    return placed.join(table, "slot", "left").select(*(c for c in df.columns if c not in ("slot", "shard")), "slot", "shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))


def sql() -> str:
    owner = ",".join(map(str, lookup_table(SHARDS, TABLE_SIZE)))
    return f"""
    WITH slots AS (
        SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents
    ), held AS (SELECT string_split('{owner}', ',') AS owner)
    SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1], 3, '0') AS shard FROM slots, held"""
