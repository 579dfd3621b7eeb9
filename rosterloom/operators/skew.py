"""Joins, repeats and row numbers that hold when one key owns most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_ROWS = 100_000
HOT_BUCKETS = 1 << 16
#: Rows that one task sorts where a look-up is dealt by the size of its table.
LOOKUP_ROWS = 1_000_000


def explode_rows(df: DataFrame, array: str, name: str, position: str | None = None) -> DataFrame:
    """One row per array element; rows with none go.

    The outer form is used on purpose.  For a plain explode Catalyst infers a
    filter on the array's size and pushes it down to the scan, which repeats the
    whole computation of the array."""
    kept = [c for c in df.columns if c != array]
    if position is None:
        return df.select(*kept, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
    return df.select(*kept, F.posexplode_outer(array).alias(position, name)).where(F.col(name).isNotNull())


def hot_keys(df: DataFrame, on: list[str], parts: int) -> DataFrame:
    """Keys that own more rows than one of ``parts`` even shares, with the number
    of shares as ``_shares``.  There are fewer of them than ``parts``, so the list
    may be broadcast whatever the size of the data.

    Rows are first counted per bucket of keys, of which there is a fixed number.
    Only keys in buckets as large as a hot key are counted one by one, so that no
    task ever holds a count for every key."""
    bucket = F.pmod(F.xxhash64(*on), F.lit(HOT_BUCKETS))
    buckets = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    total = buckets.agg(F.sum("_rows")).scalar()
    heavy = buckets.where(F.col("_rows") * parts > total).select("_bucket")
    likely = df.select(*on, bucket.alias("_bucket")).join(F.broadcast(heavy), "_bucket", "left_semi")
    sizes = likely.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    shares = F.ceil(F.col("_rows") * parts / total).cast("int").alias("_shares")
    return sizes.where(F.col("_rows") * parts > total).select(*on, shares)


def lookup_parts(df: DataFrame) -> int:
    """Parts for a look-up from ``df``, which it counts: as many as a shuffle has,
    or more, so that a task's rows do not grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // LOOKUP_ROWS))


def salted_lookup(
    big: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "left", parts: int | None = None
) -> DataFrame:
    """Join ``big`` to ``small``, which holds one row per key; null keys meet nothing.

    The rows of a hot key are cut into as many parts as it has shares of the
    rows, by the columns ``spread``, and only its lookup row is repeated, once per
    part.  Rows without a key are spread over all parts.  The lookup itself is
    broadcast only by AQE, at its measured size.  More ``parts`` than a shuffle has
    are dealt as asked for.
    """
    usual = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or usual
    hot = F.broadcast(hot_keys(big, on, parts))
    shares = F.coalesce("_shares", F.lit(1))
    copies = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    salt = F.pmod(F.xxhash64(*spread), F.when(no_key, F.lit(parts)).otherwise(shares)).cast("int")
    salted = big.join(hot, on, "left").withColumn("_salt", salt).drop("_shares")
    if parts > usual:
        salted, copies = [side.repartition(parts, *on, "_salt") for side in (salted, copies)]
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def flag_repeats(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    flag: str = "is_repeat",
    applies: Column | None = None,
) -> DataFrame:
    """Mark every row but the first (by ``order``) of its key.

    First rows come from a partially aggregated ``min`` instead of a window, so
    that a key with a third of all rows is never sorted in one task; only keys
    that do repeat take part in the join.

    ``applies`` says which keys count and must depend on the key alone.  It is a
    condition inside the aggregate and not a filter, which Catalyst would push
    below the projections that work it out, and so work it out twice.
    """
    applies = F.lit(True) if applies is None else F.coalesce(applies, F.lit(False))
    place = _place(order)
    keyed = df.withColumn("_keys", F.struct(*keys))  # a struct equals itself even where its fields are null
    firsts = (
        keyed.groupBy("_keys")
        .agg(F.min(F.when(applies, place)).alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1")
        .select("_keys", "_first")
    )
    joined = salted_lookup(keyed, firsts, ["_keys"], order)
    return joined.withColumn(flag, F.coalesce(place > F.col("_first"), F.lit(False))).drop("_first", "_keys")


def _place(order: list[str]) -> Column:
    """Sorts as the columns do, nulls last."""
    return F.struct(*[part for name in order for part in (F.col(name).isNull(), F.col(name))])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key.  Only keys and order columns are aggregated; the
    wide rows meet the winners on ``keys + order``, which is as unique as rows.
    Null keys are one key, and null orders come last."""
    marked = df.withColumns({"_keys": F.struct(*keys), "_first": _place(order)})
    winners = marked.groupBy("_keys").agg(F.min("_first").alias("_first"))
    return marked.join(winners, ["_keys", "_first"], "left_semi").select(*df.columns)


def dense_index(
    df: DataFrame,
    group: list[str],
    order: list[str],
    position: str,
    name: str = "row_idx",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Gap-free index from 0 within ``group`` by ``order`` and then ``position``.

    ``position`` is an integer that is unique within ``group + order``.  Groups of
    up to ``chunk_rows`` rows are sorted whole.  In larger ones, which are few, rows
    are numbered inside chunks of ``chunk_rows`` positions, and each chunk gets the
    count of the rows before it: a group of any size is cut into bounded sorts, and
    only one row per chunk goes through the running sum.  The whole rows are dealt
    once, as the chunks meet their counts where they are.
    """
    grouped = df.withColumn("_group", F.struct(*group))  # equals itself even where its fields are null
    sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    # At most one row per chunk_rows rows of the table.
    large = F.broadcast(sizes.where(F.col("_rows") > chunk_rows).select("_group", F.lit(True).alias("_large")))
    chunk = F.struct(*order, F.floor(F.col(position) / F.lit(chunk_rows)).cast("bigint").alias("_chunk"))
    chunked = grouped.join(large, "_group", "left").withColumn("_chunk", F.when(F.col("_large"), chunk)).drop("_large")
    counted = chunked.where("_chunk IS NOT NULL").groupBy("_group", "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("_group", "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_group", "_chunk").orderBy(*order, position)
    numbered = chunked.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = numbered.join(offsets, ["_group", "_chunk"], "left")
    return joined.select(*df.columns, (F.coalesce("_offset", F.lit(0)) + F.col("_inside")).cast("bigint").alias(name))
