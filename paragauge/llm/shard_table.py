"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table (an offset and a
step from its name). Shards take turns, and each claims its next free slot, until all are taken.
Every shard gets the same number of slots, give or take one, and few slots change hands when a
shard comes or goes. A row's slot is a hash of its key; one lookup in the broadcast table places it.
Placement is DataFrame functions only. The table has SLOTS rows whatever the data, so its broadcast
is bounded. A hot key is no trouble: rows are never grouped.

Defined cases: a null key is placed like the empty string; repeated rows get the same shard; an
empty table gives an empty result; a column of the input named like an output column is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4099


def _number(name: str, role: str) -> int:
    return int(hashlib.md5(f"{role}:{name}".encode()).hexdigest()[:12], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the owning shard for every slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    if slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be prime, not {slots}")
    place = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    left = slots
    while left:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            owner[place[i]] = i
            left -= 1
            if not left:
                break
    return owner


def table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows (slot, shard), made by the JVM from one literal."""
    owner = ",".join(map(str, fill(shards, slots)))
    found = F.posexplode(F.split(F.lit(owner), ",").cast("array<int>"))
    names = F.split(F.lit("\n".join(shards)), "\n")
    return (
        spark.range(1)
        .select(found.alias("slot", "owner"))
        .select("slot", F.get(names, F.col("owner")).alias("shard"))
    )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """48 bits of the key's MD5, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with the columns slot and shard."""
    clash = {"slot", "shard"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns named like the result's: {sorted(clash)}")
    lookup = F.broadcast(table(docs.sparkSession, shards, slots))
    return docs.withColumn("slot", slot_of(F.col(f"`{key}`"), slots)).join(lookup, "slot")


def write_shards(docs: DataFrame, path: str, shards: list[str], key: str = "doc_id") -> None:
    """One folder per shard; each task writes what it has, so no shard passes through one task."""
    place(docs, shards, key).drop("slot").write.partitionBy("shard").parquet(path)
