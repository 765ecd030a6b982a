"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: it starts at
one hash of its name and steps by another, which visits every slot once because the size is prime.
The shards take turns, each claiming the next free slot in its order, until the table is full. So
shards own equal numbers of slots, one apart at most, and when a shard joins or leaves, few slots
of the others change hands.

A row's slot is the hash of its key modulo the size; the table (one row per slot, so at most the
size, a parameter) is broadcast and gives its shard in constant time. Nothing is shuffled.

Edge cases: a null key is placed by the hash of all columns of its row, so that missing keys
spread over the shards as well. Equal rows go to one shard. Input columns stay; one that has the
name of a result is replaced. Shard names must differ, and the order in which they are given does
not matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.rows import give_back, hold

SIZE = 65_537
RESULTS = ["slot", "shard"]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = SIZE) -> list[str]:
    """The shard of every slot."""
    names = sorted(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and differ")
    if size < 3 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the size of the table must be a prime above 2")
    if len(names) > size:
        raise ValueError("more shards than slots")
    at = [_number(f"start:{n}") % size for n in names]
    step = [_number(f"step:{n}") % (size - 1) + 1 for n in names]
    owner: list[int | None] = [None] * size
    free = size
    while free:
        for shard in range(len(names)):
            while owner[at[shard]] is not None:
                at[shard] = (at[shard] + step[shard]) % size
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return [names[i] for i in owner]


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = SIZE) -> DataFrame:
    """All rows and columns of `docs` with slot and shard."""
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, size))), "slot long, shard string")
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"})
    key = F.md5(F.coalesce(F.col(key_col).cast("string"), whole).cast("binary"))
    slot = F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % size
    held = hold(docs, slot=slot)
    return give_back(held.join(F.broadcast(table), "slot", "left"), docs, RESULTS)


def shard_sizes(placed: DataFrame) -> DataFrame:
    """(shard, n_rows, n_slots) of the shards that have rows."""
    slots = placed.groupBy("shard", "slot").agg(F.count("*").alias("n"))
    return slots.groupBy("shard").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_slots"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; tasks write rows as they have them, so no shard is gathered in one task."""
    placed.drop("slot").write.partitionBy("shard").parquet(path)
