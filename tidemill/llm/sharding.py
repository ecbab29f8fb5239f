"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a prime-sized table, each in its own order of preference (offset + turn x skip).
The table is filled once from parameters alone and sent to the executors by a broadcast join, so a row finds its
shard by one look-up. Adding or losing a shard moves few keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table

#: Slots (a prime), and shards of the registered query. The broadcast table has SLOTS rows, whatever the data.
SLOTS, SHARDS = 65537, 64


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The owner of each slot. Every shard ends with nearly slots / len(names) of them."""
    if not names:
        raise ValueError("no shards")
    number = lambda name, salt: int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:13], 16)
    places = [number(x, "offset") % slots for x in names]
    skips = [number(x, "skip") % (slots - 1) + 1 for x in names]
    owner, free = [-1] * slots, slots
    while free:
        for i, skip in enumerate(skips):
            at = places[i]
            while owner[at] >= 0:
                at = (at + skip) % slots
            owner[at], places[i], free = i, (at + skip) % slots, free - 1
            if not free:
                break
    return owner


def lookup(spark: SparkSession, owner: list[int]) -> DataFrame:
    """The table as rows (slot, shard): a literal of two bytes a slot, cut by position."""
    if max(owner) > 0xFFFF:
        raise ValueError("at most 65,536 shards")
    packed = F.lit(bytearray(b"".join(x.to_bytes(2, "big") for x in owner)))
    slots = spark.range(len(owner)).withColumnRenamed("id", "slot")
    return slots.select("slot", F.conv(F.hex(F.substring(packed, (F.col("slot") * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("int").alias("shard"))


def slot_of(key, slots: int = SLOTS):
    """md5 of the key as text, modulo the slots; a null key counts as the text null."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("bigint") % slots


def shard(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """df with columns slot and shard (replaced where df has such names).

    Repeated and equal keys meet in a shard; a null key is placed like any other; an empty table stays empty.
    """
    df = df.withColumn("slot", slot_of(df[key], slots)).drop("shard")
    # the broadcast side has exactly `slots` rows of 12 bytes: a bound by parameter
    return df.join(F.broadcast(lookup(df.sparkSession, fill(names, slots))), "slot")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op7_sharding(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return shard(docs, "doc_id", shard_names()).select("doc_id", "slot", "shard")


def op7_sql() -> str:
    packed = "".join(f"{x:02x}" for x in fill(shard_names()))
    return f"""
with s as (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint) % {SLOTS} slot from documents),
t as (select i slot, cast('0x' || substr(p, cast(i * 2 + 1 as int), 2) as int) shard from (select unnest(range({SLOTS})) i, '{packed}' p))
select doc_id, slot, shard from s join t using (slot)"""
