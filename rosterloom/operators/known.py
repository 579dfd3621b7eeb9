"""Look-ups in a history that grows: a bitmap of its keys stands before it.

Every batch adds its keys twice: as bits of a bitmap, and as narrow rows dealt
over a fixed number of parts by hash.  A new key whose bit is not set is new
for certain; only the others are looked up, and only in the parts they fall in.
A bitmap row holds 32,768 bits in 4 KB and is joined on its number, so the index
may have any size and is never broadcast by force.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.operators.skew import salted_lookup

BITS = 1 << 24
PARTS = 256


def key_rows(df: DataFrame, columns: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """``kind, key, part, value`` of each distinct key, with the smallest value."""
    kinds = [F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in columns]
    listed = df.select(F.explode(F.array(*kinds)).alias("_k"), F.col(value).alias("value")).select("_k.*", "value")
    smallest = listed.where("key IS NOT NULL").groupBy("kind", "key").agg(F.min("value").alias("value"))
    return smallest.select("kind", "key", "value", part_of(F.col("kind"), F.col("key"), parts).alias("part"))


def part_of(kind: Column, key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), kind, key), F.lit(parts)).cast("int")


def _place(kind: Column, key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(kind, key), F.lit(bits))


def key_index(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """One bitmap over the keys of all kinds: ``bucket, bitmap``."""
    place = _place(F.col("kind"), F.col("key"), bits)
    placed = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("_bit"))
    return placed.groupBy("bucket").agg(F.bitmap_construct_agg("_bit").alias("bitmap"))


def merged_index(indexes: DataFrame) -> DataFrame:
    """The bitmaps of several batches as one."""
    return indexes.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def possible(df: DataFrame, columns: list[str], index: DataFrame, bits: int = BITS) -> DataFrame:
    """Add ``_possible``: whether any of the keys may be in the history.  False is
    certain."""
    flags = []
    for i, column in enumerate(columns):
        place = _place(F.lit(column), F.col(column).cast("string"), bits)
        named = index.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_bitmap{i}"))
        df = df.withColumn(f"_bucket{i}", F.bitmap_bucket_number(place)).join(named, f"_bucket{i}", "left")
        bit = F.bitmap_bit_position(place).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"_bitmap{i}"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        set_ = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)))) != 0
        df = df.withColumn(f"_on{i}", F.coalesce(set_ & F.col(column).isNotNull(), F.lit(False))).drop(f"_bucket{i}", f"_bitmap{i}")
        flags.append(f"_on{i}")
    found = reduce(lambda a, b: a | b, [F.col(f) for f in flags])
    return df.withColumn("_possible", found).drop(*flags)


def find_known(df: DataFrame, key: str, columns: list[str], history: DataFrame, index: DataFrame, bits: int = BITS, parts: int = PARTS) -> DataFrame:
    """Rows of ``df`` with any key in the history: ``key`` and ``existing_id``, the
    smallest value of its keys there.  ``history`` holds ``key_rows``, best stored
    by ``part``, so that parts without a possible hit are not read."""
    hits = possible(df.select(key, *columns), columns, index, bits).where("_possible")
    kinds = [F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in columns]
    asked = hits.select(F.col(key).alias("_id"), F.explode(F.array(*kinds)).alias("_k")).select("_id", "_k.*")
    asked = asked.where("key IS NOT NULL").withColumn("part", part_of(F.col("kind"), F.col("key"), parts))
    # One row per distinct key meets the history; a key that most rows share is one row there.
    wanted = asked.select("kind", "key", "part").distinct()
    known = history.join(wanted, ["part", "kind", "key"], "left_semi").groupBy("kind", "key").agg(F.min("value").alias("value"))
    met = salted_lookup(asked.drop("part"), known, ["kind", "key"], ["_id"], how="inner")
    return met.groupBy(F.col("_id").alias(key)).agg(F.min("value").alias("existing_id"))
