"""Sharding by a permutation-filled lookup table (operator 1), in DataFrame functions only.

The table has a prime number of slots.  Each shard has its own permutation of the slots (an offset and a skip from its name); the shards
take turns, each claiming the first free slot of its permutation, until all slots are owned.  Shares differ by at most one slot
a turn, and a shard that leaves moves few rows besides its own.  A row's slot is its key's hash modulo the table size; the table, whose size
is a parameter and not that of the data, is broadcast, so placing a row is one lookup.

A key that holds many rows goes to one shard, as a lookup table must; ``spread`` gives rows of equal key up to that many slots
by the hash of the whole row.  ``write_shards`` splits each shard's rows over ``files`` tasks, so none gathers a whole shard.

Cases: rows with a null in all keys are placed by the hash of the whole row; repeated rows go to the same shard; texts of any length are
not read; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.llm.common import free_name, table

N_SHARDS = 64
SLOTS = 8191  # prime, over a hundred slots a shard


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def fill_table(shards: dict[str, int], slots: int = SLOTS) -> list[int]:
    """Owner (index into the shards' given order) of every slot.  A shard of weight w claims w slots a turn.

    Depends on names and weights alone: turns go by name.
    """
    if not _is_prime(slots):
        raise ValueError(f"the number of slots must be prime: {slots}")
    if not shards or len(shards) > slots or min(shards.values()) < 1:
        raise ValueError("there must be 1 to `slots` shards, with weights of 1 or more")
    names = list(shards)
    walks = {}
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        walks[name] = [int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1]
    owner, free = [-1] * slots, slots
    while free:
        for name in sorted(names):
            for _ in range(min(shards[name], free)):
                at, skip = walks[name]
                while owner[at] >= 0:
                    at = (at + skip) % slots
                owner[at] = names.index(name)
                walks[name][0] = (at + skip) % slots
                free -= 1
    return owner


def lookup_table(spark: SparkSession, shards: dict[str, int], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): ``slots`` rows."""
    owners = F.from_json(F.lit(json.dumps(fill_table(shards, slots))), "array<int>")
    names = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "k")).select("slot", F.get(names, F.col("k")).alias("shard"))


def slot_of(df: DataFrame, keys: list[str], slots: int, spread: int = 1) -> Column:
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    key = F.xxhash64(*[F.col(f"`{c}`") for c in keys])
    if spread > 1:
        key = F.xxhash64(key, F.pmod(whole, F.lit(spread)))
    all_null = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in keys]).isNull()
    return F.pmod(F.when(all_null, whole).otherwise(key), F.lit(slots)).cast("int")


def place(df: DataFrame, keys: list[str], shards: dict[str, int], slots: int = SLOTS, spread: int = 1) -> DataFrame:
    """``df`` with its columns and ``slot``, ``shard`` (longer names where those are taken)."""
    slot, shard = free_name(df.columns, "slot"), free_name(df.columns, "shard")
    owners = lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    return df.withColumn(slot, slot_of(df, keys, slots, spread)).join(F.broadcast(owners), slot).select(*[F.col(f"`{c}`") for c in df.columns], slot, shard)


def write_shards(df: DataFrame, path: str, keys: list[str], shards: dict[str, int], slots: int = SLOTS, files: int = 8) -> None:
    """Write ``df`` as one Parquet folder a shard, each shard's rows through ``files`` tasks."""
    placed = place(df, keys, shards, slots)
    slot, shard = placed.columns[-2:]
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files))
    placed.repartition(F.col(shard), part).drop(slot).write.partitionBy(shard).parquet(path)


def default_shards(n: int = N_SHARDS) -> dict[str, int]:
    return {f"shard-{i:03d}": 1 for i in range(n)}


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents"), ["doc_id"], default_shards())
    return placed.select("doc_id", "slot", "shard")


QUERIES = {"op1_shard_documents": op1_shard_documents}
ORACLE_SQL: dict[str, str] = {}  # XXH64 has no SQL form; tests/llm holds the brute-force comparison
