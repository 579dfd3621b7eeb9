"""Near duplicates by SimHash and anchor points (operator 12).

A text's fingerprint has 64 bits; bit b is 1 if it is set in over half of the
hashes of its word shingles.  Fingerprints that differ in at most three bits are
linked, and documents form connected components.

Three bits split over two halves leave at most one in one of them.  The anchors of
a half are the words of a covering code: the Hamming code of 31 bits, whose words
lie within one bit of every point, and the bit that is left over as it is.  A
half's home is the one anchor within the covering radius of 1; a fingerprint is
replicated to every anchor within covering radius plus threshold (1 + 1) bits, at
most 17 a half.  The home of one side of a link is therefore among the anchors of
the other, in the half where they differ in at most one bit: nothing is missed.
Distances are then compared per anchor, homes against all.

Equal fingerprints are one from the start, and anchors without two of them, one
at home, go before the comparison.  An anchor with many fingerprints is cut into
tiles, and a tile gives a spanning forest of its links, never the pairs.  A group
in which all fingerprints are alike still costs the square of its distinct
fingerprints in comparisons, spread over tiles.

Words are what stands between blanks, tabs and line ends (ASCII), with only A-Z
lower-cased.  Fewer words than a shingle are one shingle; null texts and texts
without words have fingerprint zero, which is linked like any other.  Rows that
repeat a key keep their own rows; null keys take part, and a component without
any other key has a null id.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import code, fold_bitmap, map_groups, map_rows, materialize, with_bitmap_flag
from rosterloom.llm.jaccard_join import components
from rosterloom.operators.skew import salted_lookup

WIDTH = 3
SEED = 42
DISTANCE = 3
TILE = 2048
BITS = 1 << 23
BLOCK = 1 << 15

#: Positions 1 to 31 whose number has bit k, as a mask over the bits 0 to 30.
CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """Majority of the bits of all shingles, unsigned."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    shingles = [joined[a:b] for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), BLOCK):
        part = hashes[first : first + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    major = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(major.view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``mark``, the fingerprint as a signed number.  No shuffle."""

    def marked(rows):
        for i, value in rows:
            mark = fingerprint(value)
            yield i, mark - (1 << 64) if mark >> 63 else mark

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("_key"), code(F.col(text)).alias("_text"))
    return map_rows(source, ["_key", "_text"], marked, f"`{key}` {kind}, mark bigint")


def _half_anchors(half: Column, part: int) -> Column:
    """Anchor number and whether it is home, for every anchor within 2 bits of a
    half.  The syndrome is the place of the bit that leads home."""
    own, free = half.bitwiseAND(F.lit((1 << 31) - 1)), half.bitwiseAND(F.lit(1 << 31))
    syndrome = F.lit(0)
    for k, mask in enumerate(CHECKS):
        syndrome = syndrome + (F.bit_count(own.bitwiseAND(F.lit(mask))) % 2) * (1 << k)
    flip = lambda place: F.call_function("shiftleft", F.lit(1).cast("bigint"), place - 1)
    at = F.col(f"_syndrome{part}")
    home = F.when(at == 0, own).otherwise(own.bitwiseXOR(flip(F.greatest(at, F.lit(1)))))
    named = lambda word, bit, home: F.struct(
        (word + bit + F.lit(part << 32)).alias("anchor"), F.lit(home).alias("home")
    )
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (i < i.bitwiseXOR(at)) & (at > 0))
    second = F.transform(pairs, lambda i: named(own.bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(at))), free, False))
    near = F.array(named(home, free, True), named(home, free.bitwiseXOR(F.lit(1 << 31)), False))
    return syndrome.cast("int"), F.concat(near, second)


def anchored(marks: DataFrame) -> DataFrame:
    """One row per fingerprint and anchor it is replicated to."""
    halves = [F.col("mark").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("mark", 32)]
    both = [_half_anchors(half, part) for part, half in enumerate(halves)]
    marks = marks.select("mark", *[syndrome.alias(f"_syndrome{part}") for part, (syndrome, _) in enumerate(both)])
    listed = marks.select("mark", F.explode(F.concat(*[anchors for _, anchors in both])).alias("_at"))
    return listed.select("mark", "_at.anchor", "_at.home")


def forest(rows: list[tuple], low: int, high: int, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of homes with others of a tile; rows hold
    mark, home and part."""
    marks = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    home, part = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    group = np.arange(len(rows))
    links = []
    for i in np.flatnonzero(home).tolist():
        new = (np.bitwise_count(marks ^ marks[i]) <= distance) & (group != group[i])
        if low != high:
            new &= part != part[i]
        others = np.flatnonzero(new)
        if len(others):
            joined, first = np.unique(group[others], return_index=True)
            links += [(rows[i][0], rows[j][0]) for j in others[first].tolist()]
            group[np.isin(group, joined)] = group[i]
    return links


def linked(marks: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Links that connect all distinct fingerprints at ``distance`` bits or fewer,
    columns ``a`` and ``b``; chains may stand for links between the same ends."""
    if not 0 <= distance <= 3:
        raise ValueError("the anchors cover distances of up to three bits")
    replicas = anchored(marks)
    cells = replicas.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("held"))
    cells = materialize(cells.where("size > 1 AND held").select("anchor", "size"))
    near = with_bitmap_flag(replicas, "anchor", fold_bitmap(cells, "anchor", BITS), BITS, "_on").where("_on").drop("_on")
    members = near.join(cells, "anchor").withColumn("_parts", F.ceil(F.col("size") / tile).cast("int"))
    members = members.withColumn("part", F.pmod(F.xxhash64("mark"), F.col("_parts")).cast("int"))
    members = members.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    tiles = members.select(
        "anchor", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"), "mark", "home", "part"
    )
    found = map_groups(
        tiles, ["anchor", "low", "high"], lambda at, rows: forest(rows, at[1], at[2], distance), "a bigint, b bigint"
    )
    return found.distinct()


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Key, ``mark`` (the fingerprint, signed) and ``component_id`` (the smallest
    key of the component) of every row."""
    marked = materialize(fingerprints(df, key, text))
    kinds = materialize(marked.groupBy("mark").agg(F.min(key).alias("_first")))
    heads = components(linked(kinds.select("mark"), distance))
    rooted = kinds.join(heads.withColumnRenamed("node", "mark"), "mark", "left")
    rooted = rooted.select("mark", F.coalesce("root", "mark").alias("root"), "_first")
    smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = salted_lookup(rooted.select("mark", "root"), smallest, ["root"], ["mark"]).select("mark", "component_id")
    return salted_lookup(marked, materialize(named), ["mark"], [key]).select(key, "mark", "component_id")
