"""Sharding by jump consistent hashing (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm", 2014).

Built from DataFrame expressions alone. Law: ``key`` - the key and the number of shards decide a row's shard, and
appending a shard moves rows only into the new one, in expectation 1/(n+1) of them. No ring table exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the published algorithm: the multiplier of its 64-bit linear congruential generator.
MULTIPLIER = 2862933555777941757
#: Blocks in which the rows of a shard are numbered; a fixed number, so that no task numbers a whole shard.
BLOCKS = 4096

_M32 = 0xFFFFFFFF


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64 in 16- and 32-bit limbs: no product or sum here leaves the signed 64-bit range, as ANSI mode asks."""
    c_lo, c_hi = MULTIPLIER & _M32, MULTIPLIER >> 32
    lo, hi = key.bitwiseAND(F.lit(_M32)), F.shiftrightunsigned(key, 32)
    l0, l1 = lo.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(lo, 16)
    h0, h1 = hi.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(hi, 16)
    low = l0 * F.lit(c_lo) + F.shiftleft((l1 * F.lit(c_lo)).bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(l1 * F.lit(c_lo), 16) + lo * F.lit(c_hi) + h0 * F.lit(c_lo) + F.shiftleft((h1 * F.lit(c_lo)).bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftleft(high.bitwiseAND(F.lit(_M32)), 32).bitwiseOR(low.bitwiseAND(F.lit(_M32)))


def jump_shards(key: Column, n: int) -> Column:
    """struct(shard, grown): the shard of a 64-bit integer key among n and among n + 1 shards.

    The keys jump through 0 = j0 < j1 < ...; the shard among m is the last jump below m, so one walk gives both.
    A null key gives nulls.
    """
    if n < 1:
        raise ValueError("at least one shard is needed")
    zero = F.lit(0).cast("long")
    start = F.struct(_next_key(key).alias("k"), zero.alias("j"), zero.alias("shard"), zero.alias("grown"))

    def jump(s: Column, _: Column) -> Column:
        j = s["j"]
        ahead = ((j + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(s["k"], 33) + F.lit(1)).cast("double"))).cast("long")
        return F.when(j <= F.lit(n), F.struct(_next_key(s["k"]).alias("k"), ahead.alias("j"), F.when(j < F.lit(n), j).otherwise(s["shard"]).alias("shard"), j.alias("grown"))).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(n)), start, jump)
    return F.when(key.isNotNull(), F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown")))


def key_of(df: DataFrame, key_col: str) -> Column:
    """The 64-bit key: an integer column itself, of any other type its xxhash64."""
    kind = df.schema[key_col].dataType
    whole = isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    return F.col(key_col).cast("long") if whole else F.xxhash64(F.col(key_col))


def shard_rows(df: DataFrame, n: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_col, size, text_crc32, law, shard, slot, grown_shard of every row.

    size: UTF-8 bytes of the text plus 8. slot: numbers the rows of a shard without gaps from 0. Rows are numbered
    in 4096 blocks of a shard that the hash of key and text picks, after the counts of the blocks before; so no task
    holds a shard, nor the rows of a frequent key. Defined cases: null text counts as empty; a null key goes to shard 0 (both shards); rows with one
    key share the shard and have slots of their own; other columns are not read; an empty table gives no rows.
    """
    shards = F.coalesce(jump_shards(key_of(df, key_col), n), F.struct(F.lit(0).alias("shard"), F.lit(0).alias("grown")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    block = F.pmod(F.xxhash64(F.col(key_col), F.crc32(text.cast("binary")), F.lit(7)), F.lit(BLOCKS)).cast("int")
    named = df.select(F.col(key_col), shards.alias("_s"), block.alias("_block"), F.octet_length(text).cast("long").alias("_n"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = named.select(key_col, (F.col("_n") + 8).alias("size"), "text_crc32", F.col("_s.shard").alias("shard"), F.col("_s.grown").alias("grown_shard"), "_block")
    counts = df.select(shards["shard"].alias("_shard"), block.alias("_b")).groupBy("_shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("shard", "_block").orderBy(F.col(key_col), "text_crc32", "size")
    numbered = rows.withColumn("_rank", F.row_number().over(within) - 1)
    joined = numbered.join(base, (F.col("shard") == F.col("_shard")) & (F.col("_block") == F.col("_b")), "left")
    return joined.select(key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_base") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")
