"""Jaccard join of word n-grams by chosen paths (operator 9).

A text is the set of its runs of five words.  A run of the join grows a tree:
each set in a node chooses the shared tokens it goes on with by a hash of node
and token, so that similar sets choose alike: on average one over the share of
the larger set that a pair at the threshold has in common.  A node with few sets
is a leaf, in which all pairs are verified.  So is one whose sets are mostly near
copies of one another, by the signatures: a split would only repeat it, so it is
cut into tiles at once.  Other large nodes are split on, down to ``DEPTH`` levels,
and then cut into tiles.  Runs are repeated until a pair at the threshold is found
with probability ``recall`` even at the last level.  Most pairs meet in a leaf of
the first level and are missed far more rarely; sets of which a fifth or more of
the nodes are split take part in so many more runs that their pairs are missed no
more often than those.

Sets that are equal are one class from the start.  In a leaf, members without a
partner of fitting size and signature go before any tokens are moved, and leaves
left with the same members are worked once.  A pair counts in the first of the leaves it shares, so nothing
is counted twice and no pairs are emitted: a leaf gives the number of links of
each member and a spanning forest, from which the classes follow as connected
components.  Similarities are exact on 64-bit token hashes.

Words are what stands between white space, lower-cased.  A text of fewer than
five words is one token; null and empty texts have none, and each is a class of
its own without links.  Rows that repeat a key keep their own rows.
"""

from __future__ import annotations

import math
import struct
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import code, fold_bitmap, map_groups, map_rows, materialize, with_bitmap_flag
from rosterloom.operators.skew import salted_lookup

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
DEPTH = 3
LEAF = 1024
TILE = 1024
BINS = 16
LEAST_AGREEING = 5
SMALL_SET = 64
NEAR_SHARE = 0.5
SPLIT_SHARE = 0.2
BITS = 1 << 23
COLUMNS = 2048

U64 = np.uint64
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * _B
    x = (x ^ (x >> U64(27))) * _C
    return x ^ (x >> U64(31))


def tokens_of(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=U64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=n)
    span = min(width, n)
    total = np.full(n - span + 1, span, dtype=U64)
    for k in range(span):
        total = total * _A + hashes[k : n - span + 1 + k]
    return np.unique(mix(total))


def fingerprint(tokens: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    one, two = np.sum(mix(tokens ^ _A), dtype=U64), np.sum(mix(tokens + _B), dtype=U64)
    return struct.pack("<QQ", int(one), int(mix(np.array([two + U64(len(tokens))]))[0]))


def survival(depth: int) -> float:
    """A pair at the threshold shares at least one path on average per level; so
    it survives a level with the chance of a Poisson branching process."""
    chance = 1.0
    for _ in range(depth):
        chance = 1 - math.exp(-chance)
    return chance


def runs_for(recall: float, depth: int) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(depth))))


def runs_below(runs: int, depth: int) -> int:
    """Runs that miss a pair at the last level no more often than ``runs`` do at
    the first."""
    return math.ceil(runs * math.log(1 - survival(1)) / math.log(1 - survival(depth)) - 1e-9)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The least hash in each of ``BINS`` ranges of hashes, low half; 0 if none.
    Tokens are sorted, so it is the first from the start of the range on."""
    starts = np.arange(BINS, dtype=U64) << U64(64 - BINS.bit_length() + 1)
    places = np.searchsorted(tokens, starts)
    first = tokens[np.minimum(places, len(tokens) - 1)]
    held = (places < len(tokens)) & (first >= starts) & (first - starts < (U64(1) << U64(64 - BINS.bit_length() + 1)))
    return np.where(held, first & U64(0xFFFFFFFF) | U64(1), U64(0)).astype(np.uint32)


def children(parents: np.ndarray, tokens: np.ndarray, share: float) -> np.ndarray:
    """Nodes that a set goes to from these nodes: one for each token it chooses
    there.  Tokens are hashes already, so a short mixing with the node will do."""
    bound = share / max(1, len(tokens))
    limit = U64(int(bound * 2.0**64)) if bound < 1 else U64(2**64 - 1)
    nodes = []
    for parent in parents:
        drawn = (tokens ^ parent) * _B
        drawn ^= drawn >> U64(31)
        drawn *= _C
        nodes.append(drawn[drawn <= limit])
    return mix(np.concatenate(nodes)) if nodes else np.zeros(0, dtype=U64)


def roots(runs: int, first: int = 0) -> np.ndarray:
    return mix(np.arange(first + 1, runs + 1, dtype=U64))


def numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """``_key``, ``_text`` and ``_row``, by which a text is found again."""
    rows = df.withColumns({"_key": F.col(key).cast("bigint"), "_text": code(F.col(text))})
    return rows.withColumn("_row", F.coalesce("_key", F.xxhash64("_text")))


def sketches(
    df: DataFrame, key: str, text: str, carry: tuple[str, ...], runs: int, share: float, width: int
) -> DataFrame:
    """Per row: key, columns to carry, ``_row``, fingerprint, number of tokens,
    signature, and the nodes of the first level."""

    def sketched(rows):
        start = roots(runs)
        for *kept, value in rows:
            tokens = tokens_of(value, width)
            if len(tokens):
                nodes = children(start, tokens, share).astype(np.int64).tolist()
                yield (*kept, fingerprint(tokens), len(tokens), signature(tokens).tobytes(), nodes)
            else:
                yield (*kept, b"", 0, b"", [])

    carried = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
    source = numbered(df, key, text).select("_key", *carried, "_row", "_text")
    columns = source.columns[:-1]
    kept = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in columns)
    return map_rows(source, source.columns, sketched, f"{kept}, _set binary, n bigint, marks binary, nodes array<bigint>")


def with_tokens(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Add the tokens of each wanted set.  Texts that a bitmap of fixed size rules
    out are not shuffled; rows that only share a key are told by fingerprint."""
    texts = with_bitmap_flag(texts, "_row", fold_bitmap(wanted, "_row", BITS), BITS, "_on").where("_on")
    columns = [c for c in wanted.columns if c not in ("_row", "_set")]
    joined = texts.select("_row", "_text").join(wanted, "_row").select("_set", "_text", *columns)

    def tokenized(rows):
        for mark, value, *rest in rows:
            tokens = tokens_of(value, width)
            if len(tokens) and fingerprint(tokens) == mark:
                yield (*rest, tokens.tobytes())

    kept = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in columns)
    return map_rows(joined, joined.columns, tokenized, f"{kept}, tokens binary")


def agreeing(marks: str, others: str) -> Column:
    """In how many ranges two signatures agree."""
    part = lambda column, k: F.substring(column, 4 * k + 1, 4)
    none = F.lit(bytes(4))
    same = [((part(marks, k) == part(others, k)) & (part(marks, k) != none)).cast("int") for k in range(BINS)]
    return reduce(lambda a, b: a + b, same)


def near_nodes(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Nodes whose sets mostly agree with one of them as near copies do."""
    members = materialize(large.select("node", "rep").join(sets.select("rep", "marks"), "rep"))
    pivots = members.groupBy("node").agg(F.min_by("marks", "rep").alias("_pivot"))
    compared = salted_lookup(members, pivots, ["node"], ["rep"], how="inner")
    alike = (agreeing("marks", "_pivot") >= LEAST_AGREEING).cast("double")
    return compared.groupBy("node").agg((F.avg(alike) >= NEAR_SHARE).alias("near"))


def leaf_members(
    sets: DataFrame, texts: DataFrame, runs: int, depth: int, leaf: int, share: float, width: int
) -> DataFrame:
    """Rows (leaf, size, rep) of all leaves.  Sets in nodes that are split are
    read again and sent on by one more token, level after level.  A pair that
    shares no leaf of the first level shares split nodes, so both of its sets are
    among those read; if such nodes are more than a few of a set's own, it takes
    part in the further runs from the second level on."""

    def splitter(more):
        def split(rows):
            for rep, parents, further, packed in rows:
                tokens = np.frombuffer(packed, dtype="<u8")
                parents = np.array(parents, dtype=np.int64).astype(U64)
                if further:
                    parents = np.concatenate([parents, children(more, tokens, share)])
                for node in children(parents, tokens, share).astype(np.int64).tolist():
                    yield node, rep

        return split

    rows, found = sets.select(F.explode("nodes").alias("node"), "rep"), None
    for level in range(1, depth + 1):
        sizes = materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        near = with_bitmap_flag(rows, "node", fold_bitmap(sizes, "node", BITS), BITS, "_on").where("_on").drop("_on")
        shared = materialize(near.join(sizes, "node"))
        leaves = shared if level == depth else shared.where(F.col("size") <= leaf)
        leaves = leaves.select(F.col("node").alias("leaf"), "size", "rep")
        found = leaves if found is None else found.unionByName(leaves)
        large = shared.where(F.col("size") > leaf)
        if level == depth or large.isEmpty():
            return found
        large = materialize(salted_lookup(large, materialize(near_nodes(large, sets)), ["node"], ["rep"]))
        found = found.unionByName(large.where("near").select(F.col("node").alias("leaf"), "size", "rep"))
        parents = large.where("NOT near").groupBy("rep").agg(F.collect_list("node").alias("parents"))
        further = F.lit(level == 1) & (F.size("parents") >= F.lit(SPLIT_SHARE) * F.size("nodes"))
        parents = parents.join(sets.select("rep", "_row", "_set", "nodes"), "rep")
        parents = materialize(parents.select("rep", "parents", further.alias("further"), "_row", "_set"))
        split = splitter(roots(runs_below(runs, depth), runs))
        tokens = with_tokens(texts, parents, width)
        rows = materialize(map_rows(tokens, ["rep", "parents", "further", "tokens"], split, "node bigint, rep bigint").distinct())
    return found


def promising(members: DataFrame, sets: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Members of a leaf that have a partner there whose size and signature allow
    the similarity.  Only signatures travel; of a pair at the threshold, fewer
    than ``LEAST_AGREEING`` of the signature agree with a chance of about 1e-6."""

    def alike(group, rows):
        _, low, high = group
        own = np.array([r[2] for r in rows])
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        n = np.array([r[3] for r in rows], dtype=np.float64)
        marks = np.frombuffer(b"".join(r[4] for r in rows), dtype="<u4").reshape(len(rows), BINS)
        smaller = np.minimum(n[left][:, None], n[right][None, :])
        fits = smaller >= threshold * np.maximum(n[left][:, None], n[right][None, :]) - 1e-9
        agree = np.zeros(fits.shape, dtype=np.int8)
        for k in range(BINS):
            agree += (marks[left, k][:, None] == marks[right, k][None, :]) & (marks[left, k] > 0)[:, None]
        fits &= (agree >= LEAST_AGREEING) | (smaller < SMALL_SET)
        if low == high:
            np.fill_diagonal(fits, False)
        kept = {*left[fits.any(axis=1)].tolist(), *right[fits.any(axis=0)].tolist()}
        return [(group[0], rows[i][0], rows[i][1]) for i in sorted(kept)]

    rows = tiled(members.join(sets.select("rep", "n", "marks"), "rep").select("leaf", "size", "rep", "n", "marks"), tile)
    rows = rows.select("leaf", "low", "high", "size", "rep", "_own", "n", "marks")
    return map_groups(rows, ["leaf", "low", "high"], alike, "leaf bigint, size bigint, rep bigint").distinct()


def distinct_leaves(members: DataFrame) -> DataFrame:
    """Keep one of the leaves that have the same members, cut alike into tiles."""
    marks = members.groupBy("leaf", "size").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.bit_xor(F.xxhash64("rep")).alias("_one"),
        F.bit_xor(F.xxhash64("rep", F.lit("second"))).alias("_two"),
    )
    kept = marks.groupBy("_rows", "_one", "_two").agg(F.min_by("leaf", F.struct("size", "leaf")).alias("leaf")).select("leaf")
    return members.join(kept, "leaf", "left_semi")


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted sets, by products of
    0/1 matrices over the tokens that both lists hold, some columns at a time."""
    left, right = np.concatenate(sets), np.concatenate(others)
    shared = np.intersect1d(left, right)
    counts = np.zeros((len(sets), len(others)), dtype=np.float32)
    if not len(shared):
        return counts
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (sets, others)]
    places = [np.searchsorted(shared, flat) for flat in (left, right)]
    places = [np.where(shared[np.minimum(p, len(shared) - 1)] == flat, p, -1) for p, flat in zip(places, (left, right))]
    for first in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - first)
        dense = []
        for row, place, size in zip(rows, places, (len(sets), len(others))):
            here = (place >= first) & (place < first + width)
            matrix = np.zeros((size, width), dtype=np.float32)
            matrix[row[here], place[here] - first] = 1
            dense.append(matrix)
        counts += dense[0] @ dense[1].T
    return counts


def verify(leaf: int, rows: list[tuple], same: bool, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple]:
    """Links and a spanning forest of the pairs between two sides of a leaf.
    Rows hold rep, copies, leaves and tokens."""
    tokens = [np.frombuffer(r[3], dtype="<u8") for r in rows]
    sizes = np.array([len(t) for t in tokens], dtype=np.float64)
    inter = overlaps([tokens[i] for i in left], [tokens[i] for i in right]).astype(np.float64)
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    linked = inter >= threshold * union - 1e-9
    if same:
        linked &= np.triu(np.ones_like(linked), 1)
    a, b = np.nonzero(linked)
    if not len(a):
        return []
    weight = np.array([r[1] for r in rows], dtype=np.int64)
    earlier = [np.sort(np.array([x for x in r[2] if x < leaf], dtype=np.int64)).astype(U64) for r in rows]
    fresh = linked & ~(overlaps([earlier[i] for i in left], [earlier[i] for i in right]) > 0)
    links = np.zeros(len(rows), dtype=np.int64)
    np.add.at(links, left, fresh @ weight[right])
    np.add.at(links, right, fresh.T @ weight[left])
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = [(rows[i][0], None, int(links[i])) for i in np.flatnonzero(links).tolist()]
    for i, j in zip(left[a].tolist(), right[b].tolist()):
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((rows[i][0], rows[j][0], 0))
    return out


def tiled(members: DataFrame, tile: int) -> DataFrame:
    """Give each member the tiles of its leaf in which it meets others: all pairs
    of ``ceil(size / tile)`` parts, so that one task never holds more than two."""
    parts = F.ceil(F.col("size") / tile).cast("int")
    rows = members.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return rows.select(*members.columns, "_own", low.alias("low"), high.alias("high"))


def components(edges: DataFrame) -> DataFrame:
    """The smallest member of each node's connected component, by alternating
    large and small stars.  Every round is written to the shared folder; columns
    ``node`` and ``root``, for nodes that are not their own root."""
    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def jaccard_classes(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    depth: int = DEPTH,
    leaf: int = LEAF,
    tile: int = TILE,
    width: int = WIDTH,
) -> DataFrame:
    """Key, ``class_id`` (the smallest key of its class), ``class_size`` and
    ``n_links`` (other rows with a similarity of at least ``threshold``) of every
    row, with the columns to ``carry``."""
    runs = runs_for(recall, depth)
    share = 1 / threshold  # a pair has at least this part of the larger set in common
    sketch = materialize(sketches(df, key, text, carry, runs, share, width))
    kinds = sketch.where("n > 0").groupBy("_set").agg(
        F.min("_row").alias("_row"), F.min("_key").alias("_first"), F.count(F.lit(1)).alias("copies"),
        F.first(F.struct("n", "marks", "nodes")).alias("_same"),
    )
    sets = materialize(kinds.select(F.monotonically_increasing_id().alias("rep"), "_set", "_row", "_first", "copies", "_same.*"))
    texts = numbered(df, key, text).select("_row", "_text")
    members = promising(leaf_members(sets, texts, runs, depth, leaf, share, width), sets, threshold, tile)
    members = materialize(distinct_leaves(materialize(members)))

    wanted = members.groupBy("rep").agg(F.collect_list(F.struct("leaf", "size")).alias("leaves"))
    wanted = materialize(wanted.join(sets.select("rep", "_set", "_row", "copies"), "rep"))
    rows = with_tokens(texts, wanted, width).select(
        "rep", "copies", F.col("leaves.leaf").alias("leaves"), "tokens", F.explode("leaves").alias("_leaf")
    )
    rows = tiled(rows.select("rep", "copies", "leaves", "tokens", "_leaf.leaf", "_leaf.size"), tile)

    def verified(group, members):
        at, low, high = group
        members = sorted({m[0]: m for m in members}.values(), key=lambda m: m[0])
        own = np.array([m[5] for m in members])
        return verify(at, members, low == high, np.flatnonzero(own == low), np.flatnonzero(own == high), threshold)

    verdicts = materialize(map_groups(rows, ["leaf", "low", "high"], verified, "rep bigint, partner bigint, links bigint"))

    links = verdicts.groupBy("rep").agg(F.sum("links").alias("links"))
    heads = components(verdicts.where("partner IS NOT NULL").select(F.col("rep").alias("a"), F.col("partner").alias("b")))
    graded = sets.select("rep", "_set", "_first", "copies").join(links, "rep", "left")
    graded = graded.join(heads.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    graded = materialize(graded)
    classes = graded.groupBy("root").agg(F.min("_first").alias("class_id"), F.sum("copies").alias("class_size"))
    linked = salted_lookup(graded, classes, ["root"], ["rep"], how="inner").select(
        "_set", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    rows = sketch.drop("_row", "marks", "nodes")
    own = [F.col("_key").alias(key), *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)]]
    full = rows.where("n > 0").join(linked, "_set").select(*own, "class_id", "class_size", "n_links")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    bare = rows.where("n = 0").select(*own, F.col("_key").alias("class_id"), one.alias("class_size"), none.alias("n_links"))
    return full.unionByName(bare)
