"""Reports that are kept up to date from batch to batch.

A batch adds signed rows: what it takes away counts minus one, what it puts in
its place counts plus one.  A report is the sum of the rows of all batches and
never reads jobs, rows or events again.  Latencies are kept as sketches, which
are merged when a report is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SKETCH_K = 200
#: Rank error of a sketch of this size, with 99 % confidence.
RANK_ERROR = 0.0165
PERCENTILES = (0.5, 0.95, 0.99)


def signed_changes(before: DataFrame | None, after: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """``measure, slot, n``: for every measure, a column that names the slot a row
    counts in, the rows of ``after`` less those of ``before``; null slots count
    nowhere, slots that end up even are left out."""

    def counted(rows: DataFrame, sign: int) -> DataFrame:
        slots = [F.struct(F.lit(name).alias("measure"), slot.cast("string").alias("slot")) for name, slot in measures.items()]
        return rows.select(F.explode(F.array(*slots)).alias("_s"), F.lit(sign).alias("_n")).select("_s.*", "_n")

    both = counted(after, 1) if before is None else counted(after, 1).unionAll(counted(before, -1))
    sums = both.where("slot IS NOT NULL").groupBy("measure", "slot").agg(F.sum("_n").alias("n"))
    return sums.where("n <> 0")


def log_changes(log: DataFrame, key: str, order: Sequence[str], batch: str, measures: dict[str, Column]) -> DataFrame:
    """The signed rows of every batch of a log that holds each new state of a key:
    ``batch, measure, slot, n``.  A state counts from its batch until that of the
    next state of its key."""
    names = list(measures)
    states = log.select(key, *order, F.col(batch).alias("_batch"), *[measures[m].cast("string").alias(m) for m in names])
    following = Window.partitionBy(key).orderBy(*order)
    ends = states.withColumn("_until", F.lead("_batch").over(following))
    steps = [F.struct(F.col("_batch").alias("batch"), F.lit(1).alias("sign")), F.struct(F.col("_until").alias("batch"), F.lit(-1).alias("sign"))]
    signed = ends.select(F.explode(F.array(*steps)).alias("_s"), *names).where("_s.batch IS NOT NULL")
    slots = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("slot")) for m in names])
    rows = signed.select("_s.batch", "_s.sign", F.explode(slots).alias("_m")).select("batch", "sign", "_m.*").where("slot IS NOT NULL")
    return rows.groupBy("batch", "measure", "slot").agg(F.sum("sign").alias("n")).where("n <> 0")


def rolled_up(changes: DataFrame, measure: str | None = None) -> DataFrame:
    """The report after all batches of ``changes``: ``measure, slot, n``."""
    rows = changes if measure is None else changes.where(F.col("measure") == measure)
    return rows.groupBy("measure", "slot").agg(F.sum("n").alias("n")).where("n <> 0")


def latency_sketches(events: DataFrame, key: str = "agent", value: str = "duration_s", time: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """One mergeable quantile sketch per stage and hour, of bounded size."""
    hour = F.date_trunc("hour", F.col(time)).alias("hour")
    return events.where(F.col(value).isNotNull()).groupBy(key, hour).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("runs")
    )


def latency_percentiles(sketches: DataFrame, key: str = "agent", percentiles: Sequence[float] = PERCENTILES, k: int = SKETCH_K) -> DataFrame:
    """Percentiles of each stage from the stored sketches of any hours."""
    merged = sketches.groupBy(key).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("_all"), F.sum("runs").alias("runs"))
    figures = [F.kll_sketch_get_quantile_double("_all", F.lit(float(p))).alias(f"p{round(p * 100)}") for p in percentiles]
    return merged.select(key, "runs", *figures)


def rank_errors(events: DataFrame, found: DataFrame, key: str = "agent", value: str = "duration_s", percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """How far, in shares of the rows, each percentile is from its exact place."""
    names = {p: f"p{round(p * 100)}" for p in percentiles}
    rows = events.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"))
    joined = rows.join(found.select(key, *names.values()), key)
    counts = [
        c
        for name in names.values()
        for c in (F.count_if(F.col("_v") < F.col(name)).alias(f"_below_{name}"), F.count_if(F.col("_v") <= F.col(name)).alias(f"_upto_{name}"))
    ]
    sums = joined.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *counts)

    def off(p: float) -> Column:
        low, high = F.col(f"_below_{names[p]}") / F.col("_n"), F.col(f"_upto_{names[p]}") / F.col("_n")
        return F.greatest(F.lit(0.0), low - p, p - high).alias(names[p])

    return sums.select(key, *[off(p) for p in percentiles])


def within(errors: DataFrame, key: str = "agent", bound: float = RANK_ERROR, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    good = reduce(lambda a, b: a & b, [F.col(f"p{round(p * 100)}") <= bound for p in percentiles])
    return errors.select(key, good.alias("within_bound"))
