"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged

#: Fixed values of the linear congruential generator of Lamping and Veach's jump consistent hash.
LCG = 2862933555777941757
_MASK22, _MASK20 = (1 << 22) - 1, (1 << 20) - 1


def lcg_step(key: Column) -> Column:
    """key * LCG + 1 modulo 2**64. ANSI arithmetic doesn't wrap, so it is done in limbs of 22, 22 and 20 bits."""
    k = [key.bitwiseAND(F.lit(_MASK22)), F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(_MASK22)), F.shiftrightunsigned(key, 44)]
    c = [F.lit(LCG & _MASK22), F.lit(LCG >> 22 & _MASK22), F.lit(LCG >> 44)]
    t0 = k[0] * c[0] + 1
    t1 = k[0] * c[1] + k[1] * c[0] + F.shiftright(t0, 22)
    t2 = k[0] * c[2] + k[1] * c[1] + k[2] * c[0] + F.shiftright(t1, 22)
    low, mid, high = t0.bitwiseAND(F.lit(_MASK22)), t1.bitwiseAND(F.lit(_MASK22)), t2.bitwiseAND(F.lit(_MASK20))
    return low.bitwiseOR(F.shiftleft(mid, 22)).bitwiseOR(F.shiftleft(high, 44))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to shards - 1. Growing by one shard moves a key into the new shard or not at all.

    Every jump goes up by one at least, so shards steps are enough; their number is about ln(shards), and more than
    200 of them don't occur in practice for any number of shards.
    """

    def step(s: Column, _: Column) -> Column:
        k = lcg_step(s["k"])
        jumped = F.struct(k.alias("k"), s["j"].alias("b"), F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1))).cast("long").alias("j"))
        return F.when(s["j"] < shards, jumped).otherwise(s)

    start = F.struct(key.cast("long").alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, 200) + 1)), start, step, lambda s: s["b"]).cast("int")


def shard_by_key(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_per_group: int = 5_000) -> DataFrame:
    """size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard of each row.

    Slots are numbered in groups of about rows_per_group rows: each shard's rows are dealt to groups by a hash of the id,
    the groups' sizes are counted before the shuffle, and a group's rows begin where the groups before it end. The id and the
    number of shards alone decide the shard; a null id is key 0, and repeated ids share a shard. A null text has no bytes.
    Equal texts under different ids are dealt apart, as the key law says.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = staged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            jump_hash(key, shards).alias("shard"),
            jump_hash(key, shards + 1).alias("grown_shard"),
        )
    )
    groups = max(1, -(-sized.count() // (shards * rows_per_group)))
    rows = sized.withColumn("part", (F.shiftrightunsigned(lcg_step(F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long"))), 33) % groups).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("row", F.row_number().over(W.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")))
    return numbered.join(before, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("row") - 1).alias("slot"), "grown_shard"
    )
