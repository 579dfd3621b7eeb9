"""Exact duplicates by progressive refinement (operator 4), in native functions.

Texts are equal if they are after lower-casing A-Z.  Rows are first grouped by
length, those that share a length by a hash of their length and prefix, and only
those that share that too by the digest of the full text.  What survives a stage
is handed to the next as a bitmap of fixed size, which is broadcast: no text is
ever shuffled, and a full bitmap at a very large input costs hashing, not rows.
Groups come from partially aggregated maxima, and the rows of a hot text are
spread over tasks to meet their group, so one text may own most rows.

A null text is empty.  Null keys count in their group and stay only if the group
has no other key.  Rows that repeat the largest key of a group all stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import code, fold_bitmap, materialize, with_bitmap_flag
from rosterloom.operators.skew import salted_lookup

PREFIX_CHARS = 256
LENGTH_BITS = 1 << 20
PREFIX_BITS = 1 << 24


def folded(text: Column) -> Column:
    return F.translate(code(text), string.ascii_uppercase, string.ascii_lowercase)


def exact_groups(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: str | None = None,
    carry: tuple[str, ...] = (),
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """Key, ``keep_id``, ``group_size`` and ``kept`` of every row, with the columns
    to ``carry`` and, under the name given as ``digest``, the SHA-256 of every
    text.  Without that, only texts that share length and prefix are hashed whole."""
    rows = df.select(F.col(key).alias("_id"), folded(F.col(text)).alias("_norm"), *[F.col(c) for c in carry])
    length = F.octet_length("_norm")
    prefix = F.xxhash64(length, F.substring("_norm", 1, prefix_chars))
    sized = materialize(rows.select(length.alias("_length"), prefix.alias("_prefix")))

    shared = sized.groupBy("_length").count().where("count > 1")
    lengths = fold_bitmap(shared, "_length", LENGTH_BITS)
    longer = with_bitmap_flag(sized, "_length", lengths, LENGTH_BITS, "_alike").where("_alike")
    prefixes = fold_bitmap(longer.groupBy("_prefix").count().where("count > 1"), "_prefix", PREFIX_BITS)

    flagged = with_bitmap_flag(rows.withColumn("_prefix", prefix), "_prefix", prefixes, PREFIX_BITS, "_alike")
    whole = F.sha2("_norm", 256)
    asked = [whole.alias(digest)] if digest else []
    hashed = materialize(flagged.select("_id", *carry, *asked, F.when(F.col("_alike"), whole).alias("_whole")))

    groups = (
        hashed.where("_whole IS NOT NULL")
        .groupBy("_whole")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    kept = [*carry, *([digest] if digest else [])]
    shape = [F.col("_id").alias(key), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), *kept]
    alone = hashed.where("_whole IS NULL").select("*", F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    grouped = salted_lookup(hashed.where("_whole IS NOT NULL"), groups, ["_whole"], ["_id"], how="inner")
    return alone.select(*shape).unionByName(grouped.select(*shape))
