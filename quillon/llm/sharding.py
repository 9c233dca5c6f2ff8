"""Sharding by jump consistent hashing, in DataFrame expressions only.

A stable integer key and the number of shards decide the shard; going from n
to n + 1 shards moves a row only into the new shard.  There is no ring table
and no state: the 64-bit congruential steps of the published algorithm
(Lamping and Veach, 2014) are evaluated on two 32-bit halves, as ANSI
arithmetic does not wrap.

Nulls: a null key counts as key 0; a null text has no bytes.  Empty tables
give empty results.  Repeated rows each get their own slot, ties in any order.
Texts of any length count whole.  Only key and text are read; other columns take
no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import documents, salted_slots

# Fixed values of the published algorithm: multiplier and increment.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

N_SHARDS = 40
OVERHEAD_BYTES = 16
_LOW = 0xFFFFFFFF


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard of each key in 0..n_shards-1 (int).

    Each step moves at least one bucket on, so ``n_shards`` steps always
    suffice; steps after the end leave the state as it is.
    """
    low, high = MULTIPLIER & _LOW, MULTIPLIER >> 32

    def times(x: Column, k: int) -> tuple[Column, Column]:
        """x * k for x, k < 2**32: both products fit a long."""
        return x * F.lit(k & 0xFFFF), x * F.lit(k >> 16)

    def step(s: Column, _: Column) -> Column:
        p0, p1 = times(s.lo, low)
        q0, q1 = times(s.lo, high)
        r0, r1 = times(s.hi, low)
        low_sum = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + F.lit(INCREMENT)
        high_sum = (
            F.shiftright(low_sum, 32) + F.shiftright(p1, 16)
            + q0 + F.shiftleft(q1.bitwiseAND(0xFFFF), 16)
            + r0 + F.shiftleft(r1.bitwiseAND(0xFFFF), 16)
        )
        hi, lo = high_sum.bitwiseAND(_LOW), low_sum.bitwiseAND(_LOW)
        far = F.floor((s.j + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s.j.alias("b"), far.cast("long").alias("j"))
        return F.when(s.j < n_shards, moved).otherwise(s)

    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_LOW)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, step, lambda s: s.b).cast("int")


def place(slim: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", n_salts: int = 64) -> DataFrame:
    """Adds law, shard, grown_shard and slot to rows of (key, size, text_crc32).

    Slots are gapless within a shard and are numbered in ``n_salts`` parts, so
    that no task holds a whole shard.
    """
    placed = slim.select(
        "*",
        F.lit("key").alias("law"),
        jump_hash(F.col(key), n_shards).alias("shard"),
        jump_hash(F.col(key), n_shards + 1).alias("grown_shard"),
    )
    return salted_slots(placed, "shard", [key, "text_crc32"], [key, "text_crc32", "size"], "slot", n_salts)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32): all that placement needs, so texts stay in the scan."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        key,
        (F.octet_length(body) + F.lit(OVERHEAD_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )


def op4_jump_sharding(spark, sf_dir):
    return place(measure(documents(spark, sf_dir))).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
