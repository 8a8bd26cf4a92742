"""Placing rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size:
it starts at one slot and goes on by a fixed step, both from a hash of its name.  The
shards take turns, each claiming the first slot in its order that is still free, until
the table is full.  Shares differ by one slot at most, and when shards come or go few
slots change hands.  The table's size is a parameter and does not grow with the data;
it is broadcast, and a row's place is one lookup by the hash of its key.

Defined results: equal keys go to one shard; an empty key is a key like any other; a
row whose key is null is placed by a hash of its other columns, so that rows without a
key spread out; repeated rows share a place; an empty table stays empty.  With one
shard everything goes there.  Given columns stay; those named ``slot`` or ``shard``
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_slots(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The owner (position in ``shards``) of every slot."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be prime, not {slots}")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards need different names, and no more of them than slots")
    place = [_number("start:" + s) % slots for s in shards]
    stride = [_number("step:" + s) % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while owner[place[k]] >= 0:
            place[k] = (place[k] + stride[k]) % slots
        owner[place[k]] = k
    return owner


def slot_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``slot, shard`` as a DataFrame of exactly ``slots`` rows."""
    owners = F.split(F.lit(",".join(map(str, fill_slots(shards, slots)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1, numPartitions=1).select(F.posexplode(owners).alias("slot", "owner")).select(
        F.col("slot").cast("long"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard")
    )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot, from the first 60 bits of its MD5."""
    digits = F.substring(F.md5(key.cast("string").cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Append ``slot`` and ``shard``."""
    given = df.drop(*[c for c in df.columns if c.lower() in ("slot", "shard")])
    others = [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) for c in given.columns if c.lower() != key.lower()]
    spread = F.concat_ws("\x1f", F.lit(""), *others)
    slot = slot_of(F.coalesce(F.col(key).cast("string"), spread), slots)
    table = F.broadcast(slot_table(df.sparkSession, shards, slots))  # ``slots`` rows, whatever the data
    return given.withColumn("slot", slot).join(table, "slot").select(*[f"`{c}`" for c in given.columns], "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str, shards: Sequence[str] = SHARDS, files: int = 1) -> None:
    """Write one folder per shard, each as ``files`` files; a shard is no task's only work."""
    placed = place(df, key, shards)
    placed.repartition(F.col("shard"), F.pmod(F.xxhash64(key), F.lit(files))).write.partitionBy("shard").parquet(path)
