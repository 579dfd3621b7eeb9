"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.session import ensure_checkpoint_dir, ship_package

BITMAP_BITS = 32_768  # bits in one row of Spark's bitmap_construct_agg


class Recent(dict):
    """Values by word, worked out on demand by ``find``; at most twice ``most``.
    When the newer half is full it takes the place of the older one, whose words
    come back as they are met again, so frequent words are never worked out twice.
    Words over 40 letters and values of None are not kept."""

    def __init__(self, find: Callable, most: int) -> None:
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.find(word)
        if found is not None and len(word) <= 40:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


def give_back() -> None:
    """Return freed memory to the system: a worker lives on for other stages, and
    what it has used once would stay counted as its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_rows(
    df: DataFrame, columns: list[str], function: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str
) -> DataFrame:
    """Run ``function`` over the rows of each partition, in Arrow batches.

    ``function`` gets an iterator over the tuples of one batch and yields result
    tuples; one batch of either is in memory at a time.  Only the named columns
    travel, so other columns, whatever their names, are untouched.
    """
    ship_package(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)
    arrow = pa.schema([pa.field(f.name, f.type) for f in arrow])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = zip(*[_values(column) for column in batch.columns]) if batch.num_columns else ()
            rows: list[tuple] = []
            for row in function(source):
                rows.append(row)
                if len(rows) >= 8192:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)
        give_back()

    return df.select(*columns).mapInArrow(run, target)


def map_stream(
    df: DataFrame, columns: list[str], function: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str
) -> DataFrame:
    """As ``map_rows``, but ``function`` gets one iterator over the whole
    partition, so that it may keep a bounded state and yield at its end."""
    ship_package(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(target)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*[_values(column) for column in batch.columns]))
        results = iter(function(stream))
        while rows := list(itertools.islice(results, 8192)):
            yield _batch(rows, arrow)
        give_back()

    return df.select(*columns).mapInArrow(run, target)


def map_groups(
    df: DataFrame, keys: list[str], function: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str
) -> DataFrame:
    """Run ``function`` over the rows of each group, which must be of bounded
    size.  Rows are dealt by the keys and sorted, and groups are read off the
    sorted stream, which costs far less for many small groups than handing over
    each of them on its own."""
    ship_package(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(target)])
    columns = [*keys, *[c for c in df.columns if c not in keys]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*[_values(column) for column in batch.columns]))
        rows: list[tuple] = []
        for group, members in itertools.groupby(stream, key=lambda row: row[: len(keys)]):
            rows += function(group, [row[len(keys) :] for row in members])
            if len(rows) >= 8192:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)
        give_back()

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, target)


def _values(column: pa.Array) -> Iterator:
    """Python values one at a time, so that a batch of long texts is not held twice."""
    return (value.as_py() for value in column)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there:
    later uses do not repeat its work, read only the columns they need, and a lost
    executor takes nothing along."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_bitmap(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """Mark the hashes of a column in a bitmap of ``bits`` bits.

    The result has at most ``bits / 32768`` rows of 4 KB, whatever the number of
    keys, and may therefore be broadcast: 2**24 bits are 2 MB."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    return (
        keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
        .groupBy("_bucket")
        .agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    )


def with_bitmap_flag(df: DataFrame, column: str, bitmap: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add whether the column's hash is marked.  True for every key that was
    folded in, and for others by chance; only a saving, never a decision."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    looked = df.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmap), "_bucket", "left")
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.col("_bitmap").substr(F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)))) != 0
    return looked.withColumn(flag, F.coalesce(marked, F.lit(False))).drop("_bucket", "_bitmap")


def code(column: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(column, F.lit(""))


def without(df: DataFrame, dropped: DataFrame, key: str, mark: str, bits: int = 1 << 24) -> DataFrame:
    """Rows of ``df`` whose key and mark (a hash of their content) are not listed
    in ``dropped``.  Only rows that a bitmap of fixed size cannot clear are
    shuffled to meet the list; all others, with their texts, stay where they are."""
    listed = dropped.select(F.col(key).alias("_key"), F.col(mark).alias("_mark")).distinct()
    listed = materialize(listed.withColumn("_both", F.xxhash64("_key", "_mark")))
    both = df.withColumn("_both", F.xxhash64(key, mark))
    flagged = with_bitmap_flag(both, "_both", fold_bitmap(listed, "_both", bits), bits, "_on")
    clear = flagged.where("NOT _on").drop("_on", "_both")
    doubtful = flagged.where("_on").drop("_on")
    same = doubtful[key].eqNullSafe(listed["_key"]) & doubtful[mark].eqNullSafe(listed["_mark"]) & (doubtful["_both"] == listed["_both"])
    return clear.unionByName(doubtful.join(listed, same, "left_anti").drop("_both"))
