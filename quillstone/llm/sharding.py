"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: offset, offset + skip, offset +
2 skip, ... Shards take turns, and each claims the first slot of its order that is still free. So slots
are even to within one, and when a shard goes, few slots change hands other than its own. A row's slot is
a hash of its key; the table is broadcast (its size is a parameter), so placement needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import md5_long

#: A prime, over a hundred slots a shard.
SLOTS = 4099
SHARDS = 32


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): slots rows, the shard as its place in the list. slots must be a prime.

    A shard's rank of slot s is (s - offset) / skip modulo the prime, so the free slot that it likes best
    is a minimum over the free slots.
    """
    if not shards or slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be named, slots a prime over 2")
    p = F.lit(slots).cast("long")
    each = F.array(*[F.lit(x) for x in shards])
    offset = F.transform(each, lambda x: md5_long(x, F.lit("offset")) % p)
    skip = F.transform(each, lambda x: md5_long(x, F.lit("skip")) % (p - 1) + 1)
    # skip to the power of slots - 2 is its inverse: by squaring, over the bits of the exponent.
    bits = F.array(*[F.lit(int(b)) for b in bin(slots - 2)[2:]])
    inverse = F.transform(skip, lambda s: F.aggregate(bits, F.lit(1).cast("long"), lambda x, b: x * x % p * F.when(b == 1, s).otherwise(1) % p))
    start = F.struct(F.sequence(F.lit(0).cast("long"), p - 1).alias("free"), F.array().cast("array<long>").alias("claims"))

    def turn(state, t):
        i = (t % len(shards) + 1).cast("int")
        o, k, inv = (F.element_at(F.col(c), i) for c in ("offset", "skip", "inverse"))
        best = F.array_min(F.transform(state["free"], lambda s: (s - o + p) * inv % p))
        slot = (o + best * k) % p
        return F.struct(F.array_remove(state["free"], slot).alias("free"), F.concat(state["claims"], F.array(slot)).alias("claims"))

    one = spark.range(1).select(offset.alias("offset"), skip.alias("skip"), inverse.alias("inverse"))
    claims = F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, turn, lambda s: s["claims"])
    return one.select(F.posexplode(claims).alias("turn", "slot")).select("slot", (F.col("turn") % len(shards)).cast("long").alias("shard"))


def place(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """(row, slot, shard): each row of docs as a struct, with its place. Rows without a key share one slot;
    repeated rows share theirs; an empty table gives none. Nothing is shuffled: the table has ``slots``
    rows, whatever the input."""
    table = lookup_table(docs.sparkSession, shards or names(), slots)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    slot = md5_long(F.col("row").getField(key).cast("string")) % slots
    return rows.withColumn("slot", slot).join(F.broadcast(table), "slot").select("row", "slot", "shard")
