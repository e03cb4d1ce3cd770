"""Documents dealt to shards through a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size,
given by a first slot and a step.  The shards take turns, each claiming its
best slot that is still free, so all get nearly the same number of slots, and
when a shard is added or removed few slots change hands.  A document's key is
hashed to a slot, and the broadcast table gives its shard: no shuffle, and a
key's place does not depend on any other row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default number of slots, a prime, and the most that may be broadcast.
SLOTS, MOST_SLOTS = 65_537, 1 << 20


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard, by its place in ``shards``, of every slot.

    Shard names are distinct and not more than ``slots``.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots or slots > MOST_SLOTS:
        raise ValueError(f"give distinct shard names, at most one for each of at most {MOST_SLOTS} slots")
    if slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots is a prime of at least 3")
    at, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)
    table, free = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            table[at[shard]] = shard
            free -= 1
            if not free:
                return table


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``(slot, shard)``: the table as rows."""
    packed = ",".join(map(str, fill_table(shards, slots)))
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(packed), ",")).alias("slot", "place"))
    return rows.select("slot", F.element_at(names, F.col("place").cast("int") + 1).alias("shard"))


def slot_of(key: F.Column, slots: int = SLOTS) -> F.Column:
    """The slot of a key: the first 32 bits of the MD5 of its text, modulo the number of slots; null is the empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS, slot_into: str = "slot", into: str = "shard") -> DataFrame:
    """``docs`` with the slot and the shard of every row.

    Rows with equal keys, null among them, get the same shard; where one key
    holds many rows, give a finer key.  Existing columns named ``slot_into`` or
    ``into`` are replaced.
    """
    table = lookup(docs.sparkSession, shards, slots)
    rows = docs.drop(into).withColumn(slot_into, slot_of(F.col(key_col), slots))
    # the table has `slots` rows, at most MOST_SLOTS
    found = rows.join(F.broadcast(table), rows[slot_into] == table["slot"])
    return found.select(*(rows[c] for c in rows.columns), table["shard"].alias(into))
