"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard follows from the key and the number of shards alone: no ring and no
table. With one more shard, a key either stays or goes to the new shard. All of
it is DataFrame expressions.

Defined cases: a null key counts as key 0, which has its own shard; null texts have size 1 and the
checksum of no bytes, 0. Repeated rows go to the same shard and get a slot each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import written

# Multiplier of the published generator, in halves of 32 bits.
_MULTIPLIER_HIGH, _MULTIPLIER_LOW = divmod(2862933555777941757, 1 << 32)
_MASK = (1 << 32) - 1
#: Jumps that are made for every key; more are needed for one key in 10**20 of a million shards.
JUMPS = 64


def _times_plus_one(high: Column, low: Column) -> tuple[Column, Column]:
    """(high * 2**32 + low) * multiplier + 1 modulo 2**64, in halves, in steps that no long overflows."""
    mask = F.lit(_MASK)
    a, b = F.shiftright(low, 16), low.bitwiseAND(F.lit(0xFFFF))
    upper, lower = a * _MULTIPLIER_LOW, b * _MULTIPLIER_LOW
    ahead = lower.bitwiseAND(mask) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    carry = F.shiftright(lower, 32) + F.shiftright(upper, 16) + F.shiftright(ahead, 32)

    def cross(x: Column, factor: int) -> Column:  # x * factor modulo 2**32
        big = (F.shiftright(x, 16) * factor).bitwiseAND(F.lit(0xFFFF))
        return x.bitwiseAND(F.lit(0xFFFF)) * factor + F.shiftleft(big, 16)

    return (carry + cross(high, _MULTIPLIER_LOW) + cross(low, _MULTIPLIER_HIGH)).bitwiseAND(mask), ahead.bitwiseAND(mask)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (int) from 0 to shards - 1 of a whole-number key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(_MASK)).alias("high"), key.bitwiseAND(F.lit(_MASK)).alias("low"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("ahead")
    )

    def jump(s: Column, _: Column) -> Column:
        # A key jumps on until it would land behind the last shard; each jump goes at least one ahead.
        high, low = _times_plus_one(s["high"], s["low"])
        to = F.floor((s["ahead"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(high.alias("high"), low.alias("low"), s["ahead"].alias("shard"), to.cast("long").alias("ahead"))
        return F.when(s["ahead"] < shards, moved).otherwise(s)

    # about log(shards) jumps; only keys that aren't through after many go on with what may be left
    most = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, JUMPS))), start, jump)
    if shards <= JUMPS:
        return most["shard"].cast("int")
    rest = F.transform(F.array(most), lambda s: F.when(s["ahead"] < shards, F.aggregate(F.sequence(F.lit(JUMPS + 1), F.lit(shards)), s, jump)).otherwise(s))
    return F.element_at(rest, 1)["shard"].cast("int")


def assign(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 8, bucket_rows: int = 250_000) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row.

    Slots are numbered in two steps, so that a shard isn't one task's work: the rows
    are written once with an id of the row, whose hash deals each shard's rows to
    buckets of bucket_rows at most, whatever their keys; they are numbered inside
    their bucket, and the buckets' sizes give where each begins. Those are 65,536
    rows, or one for each bucket_rows of the table, so they may be broadcast.
    """
    k, body = F.col(key), F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("__row"),
            k.alias("__key"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            jump_shard(k, shards).alias("shard"),
            jump_shard(k, shards + 1).alias("grown_shard"),
        ),
        "sharded",
    )
    buckets = max(1, min(64, (1 << 16) // shards), -(-rows.count() // (shards * bucket_rows)))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("shard", "__bucket").count()
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("__row")
    return (
        rows.withColumn("__place", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "__bucket"])
        .select(F.col("__key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__start") + F.col("__place")).cast("long").alias("slot"), "grown_shard")
    )
