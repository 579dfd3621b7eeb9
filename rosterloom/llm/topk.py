"""Exact top-k by inner product with norm buckets (operator 8).

Vectors are turned into integers and grouped by length into bands, and bands into
blocks of bounded size.  Queries form blocks too.  A first pass over the blocks of
the longest vectors gives every query a lower bound of its k-th score.  A block
whose longest vector cannot reach the bound of any query of a group never meets
it.  In a cell of the grid a group of queries meets its blocks one after another,
longest first, and the bounds rise with what is found.  Where they meet, each
query's bound, divided by its length and the block's, is a local cosine threshold:
above 1 the block is skipped; if high, the feasible interval of the query's largest
coordinate selects candidates from a sorted list; shorter vectors are cut off.  Of
the rest a sketch tells which pairs cannot reach the bound: the leading principal
coordinates, as many as pay, and the length of what they leave out, in small
integers of which four share a double's digits.  Products of the remaining candidates are exact
integers.

Vectors that are null, empty or hold null or non-finite components take no part,
nor do null ids.  Vectors meet only those of their own dimension.  Of rows that
repeat a query's id the smallest vector is the query; every row with another id
is a candidate.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterloom.llm.common import give_back, materialize
from rosterloom.session import ship_package

SCALE = 256
BLOCK = 8192
QUERY_BLOCK = 4096
BLOCK_VALUES = 1 << 20  # of a block, whatever the dimension
GROUP_VALUES = 1 << 22  # of the queries of a cell
HELD_VALUES = 1 << 24  # of the rows that wait for their block to fill
BANDS_PER_OCTAVE = 4
COORDINATE_FROM = 0.85
COORDINATE_QUERIES = 64  # with the same largest coordinate, for which a list is sorted
COORDINATE_SHARE = 128  # a coordinate's interval holds at most this part of a block
SLACK = 1e-9
SEED_SHARE = 32
SEED_ROWS = 1 << 17  # or an eighth of the vectors, if these are few
TILE = 1024
FIELDS, WIDTH = 4, 12  # scores of the sketch in a double, and the bits of each
LENGTH = 46.0  # of the longest vector of a block in the sketch
PASSED = 4500, 100  # coordinates of the sketch a passing pair costs: always, and for each of its own
DENSE_FROM = 0.06  # share of pairs that pass the sketch, from which all are worked out
ROW = "block long, dim int, top double, size int, ids binary, data binary"
OPEN_END = -math.inf


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Id, integer vector (as exact doubles), dimension and length."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & good)

    def floored(x):
        """Doubles from 2**52 on are integers already."""
        y = x.cast("double") * SCALE
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    scaled = F.transform(vector, floored)
    rows = rows.select(F.col(key).cast("bigint").alias("_id"), scaled.alias("_x"))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("_id", "_x", F.size("_x").alias("_dim"), norm.alias("_norm"))


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))


def read_vectors(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of the rows that take part, by dimension."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    there = np.asarray(pc.and_(pc.is_valid(ids), pc.is_valid(vectors)).to_numpy(zero_copy_only=False), dtype=bool)
    numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8")
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    bad = np.flatnonzero(~np.isfinite(values))
    there &= sizes > 0
    if len(bad):
        there[np.searchsorted(starts + sizes, bad, "right")] = False
    for dim in np.unique(sizes[there]).tolist():
        rows = np.flatnonzero(there & (sizes == dim))
        if len(rows) * dim == len(values):
            found = values.reshape(-1, dim)
        else:
            found = values[starts[rows][:, None] + np.arange(dim)]
        yield numbers[rows], np.floor(found * scale) if scale != 1 else found


def alike(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the ``k`` best of any query: of those with the same
    vector, the first ``k`` of each of the ``k + 1`` smallest ids."""
    weights = np.random.default_rng(0).integers(1, 1 << 20, vectors.shape[1])  # sums are exact
    marks = np.einsum("ij,j->i", vectors, weights, dtype=np.float64)
    _, first, group, count = np.unique(marks, return_index=True, return_inverse=True, return_counts=True)
    if count.max(initial=0) <= k or (vectors != vectors[first[group]]).any():
        return np.arange(len(ids))
    order = np.lexsort((ids, group))
    new_group = np.diff(group[order], prepend=-1) != 0
    new_id = new_group | np.concatenate(([True], np.diff(ids[order]) != 0))
    place = np.arange(len(ids))
    within = place - np.maximum.accumulate(np.where(new_id, place, 0))
    passed = np.cumsum(new_id)
    distinct = passed - np.maximum.accumulate(np.where(new_group, passed, 0))
    return np.sort(order[(within < k) & (distinct <= k)])


def blocks(rows: DataFrame, size: int, by_norm: bool, key: str, vector: str, scale: float, k: int = 0) -> DataFrame:
    """Blocks of up to ``size`` vectors; ids and vectors packed, longest first.

    Each task packs its own rows, which need no shuffle, and holds a bounded number
    of them.  What it has left when its rows end are smaller blocks; the cells put
    these together.  With ``k`` rows that no query can need beside others with the
    same vector are left out."""
    ship_package(rows.sparkSession)
    names = ["block", "dim", "top", "size", "ids", "data"]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = itertools.count(TaskContext.get().partitionId() << 32 | TaskContext.get().partitionId() & 0xFFFF)
        held: dict[tuple, list] = {}
        waiting = 0

        def block(dim: int, parts: list) -> pa.RecordBatch:
            ids, norms, vectors = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids, -norms))
            ids, norms, vectors = ids[order], norms[order], vectors[order]
            if k:
                kept = alike(ids, vectors, k)
                ids, norms, vectors = ids[kept], norms[kept], vectors[kept]
            row = (next(serial), dim, float(norms[0]), len(ids), ids.astype("<i8").tobytes(), vectors.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], schema=schema)

        for batch in batches:
            for ids, vectors in read_vectors(batch.column(0), batch.column(1), scale):
                dim = vectors.shape[1]
                most = max(1, min(size, BLOCK_VALUES // dim))
                norms = lengths_of(vectors)
                bands = np.zeros(len(ids), dtype=np.int64)
                if by_norm:
                    with np.errstate(divide="ignore", over="ignore"):
                        bands = np.clip(np.nan_to_num(np.floor(np.log2(norms) * BANDS_PER_OCTAVE), neginf=-9999), -9999, 9999).astype(np.int64)
                short = np.abs(vectors).max(axis=1) < 1 << 15
                for band, small in {*zip(bands.tolist(), short.tolist())}:
                    own = np.flatnonzero((bands == band) & (short == small))
                    group = held.setdefault((dim, band, small), [])
                    have = sum(len(x[0]) for x in group)
                    while len(own):
                        part, own = own[: most - have], own[most - have :]
                        group.append((ids[part], norms[part], vectors[part].astype("<i2" if small else "<f8")))
                        have, waiting = have + len(part), waiting + len(part) * dim
                        if have == most:
                            yield block(dim, group)
                            waiting -= have * dim
                            group.clear()
                            have = 0
            while waiting > HELD_VALUES:
                largest = max(held, key=lambda x: x[0] * sum(len(y[0]) for y in held[x]))
                parts = held.pop(largest)
                waiting -= largest[0] * sum(len(y[0]) for y in parts)
                yield block(largest[0], parts)
        for (dim, _, _), parts in held.items():
            if parts:
                yield block(dim, parts)
        held.clear()
        give_back()

    return rows.select(F.col(key).cast("bigint").alias("_id"), F.col(vector).alias("_x")).mapInArrow(packed, ROW)


def unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, these in floats that hold them exactly."""
    numbers = np.frombuffer(ids, dtype="<i8")
    if len(data) == 2 * len(numbers) * dim:
        return numbers, np.frombuffer(data, dtype="<i2").reshape(-1, dim).astype(np.float32)
    return numbers, np.frombuffer(data, dtype="<f8").reshape(-1, dim)


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Some blocks as one; doubles if one of them needs them."""
    ids, vectors = zip(*parts)
    return np.concatenate(ids), np.concatenate(vectors)


def exact_kind(candidates: float, queries: float) -> type | None:
    """The float in which products of vectors of these lengths are exact: no sum of
    some of the terms exceeds the product of the lengths.  None: Python's integers."""
    largest = candidates * queries * (1 + SLACK)
    return np.float32 if largest < 2.0**24 else np.float64 if largest < 2.0**53 else None


def products(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while these hold every partial sum, else
    in Python's integers, cut off at what a long holds."""
    largest = np.abs(candidates).max(initial=0) * np.abs(queries).max(initial=0) * candidates.shape[1]
    if largest < 2.0**53:
        return (candidates.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])(candidates)
    other = np.vectorize(int, otypes=[object])(queries)
    top = (1 << 63) - 1
    return np.array([[max(-top - 1, min(top, v)) for v in row] for row in whole @ other.T], dtype=np.int64)


def feasible(share, cosine):
    """Between which values of a coordinate, of which the query has ``share``, a
    unit vector can have this cosine to it; takes numbers or arrays."""
    spread = np.sqrt(np.maximum(0.0, 1 - share * share) * np.maximum(0.0, 1 - cosine * cosine)) + SLACK
    low = np.where((share < 0) & (cosine <= -share), -2.0, share * cosine - spread)
    high = np.where((share > 0) & (cosine <= share), 2.0, share * cosine + spread)
    return low, high


def candidates_of(query: np.ndarray, length: float, bound: float, unit: np.ndarray, norms: np.ndarray, orders: dict, k: int):
    """Rows of a bucket that may reach ``bound``: all, an array of rows or None.
    Vectors stand longest first."""
    if bound <= 0 or not length:
        return slice(None)
    cosine = bound / (length * norms[0]) * (1 - SLACK) if norms[0] else math.inf
    if cosine > 1:
        return None
    reach = int(np.searchsorted(-norms, -bound / length * (1 - SLACK), "right"))
    if cosine < COORDINATE_FROM:
        return slice(0, reach)
    focus = int(np.argmax(np.abs(query)))
    order, values = sorted_by(focus, unit, orders)
    low, high = np.searchsorted(values, feasible(query[focus] / length, cosine))
    chosen = order[low:high]
    return np.sort(chosen[chosen < reach])


def sorted_by(focus: int, unit: np.ndarray, orders: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows by one coordinate and its values, kept in ``orders``."""
    if focus not in orders:
        order = np.argsort(unit[:, focus], kind="stable")
        orders[focus] = order, unit[order, focus]
    return orders[focus]


class Best:
    """The best ``k`` of a group of queries among the vectors met so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> None:
        self.query_ids, self.queries, self.k = ids, queries, k
        self.bounds = bounds.astype(np.float64)
        self.lengths = lengths_of(queries)
        self.longest = float(self.lengths.max(initial=0))
        unit = queries / np.maximum(self.lengths, 1e-300)[:, None]
        self.turn = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
        self.unit = unit @ self.turn
        self.focus = np.abs(queries).argmax(axis=1)
        self.share = queries[np.arange(len(ids)), self.focus] / np.maximum(self.lengths, 1e-300)
        self.count = np.zeros(len(ids), dtype=np.int64)
        self.ids = np.zeros((len(ids), k), dtype=np.int64)
        self.scores = np.zeros((len(ids), k), dtype=np.int64)
        self.rows = np.arange(len(ids))

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in what a block holds."""
        norms = lengths_of(vectors)
        if (np.diff(norms) > 0).any():
            order = np.lexsort((ids, -norms))
            ids, vectors, norms = ids[order], vectors[order], norms[order]
        known = (self.bounds > 0) & (self.lengths > 0)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            need = np.where(known, self.bounds / self.lengths * (1 - SLACK), OPEN_END)
            cosine = np.where(known, need / norms[0], OPEN_END)
        some = np.flatnonzero(known & (cosine <= 1))
        self.dense(np.flatnonzero(~known), ids, vectors, norms)
        if not len(some):
            return
        if len(some) <= 16:
            self.one_by_one(some, ids, vectors, norms)
            return
        some = self.by_coordinate(some, cosine, need, ids, vectors, norms)
        some = some[np.argsort(-need[some], kind="stable")]
        if len(some):
            self.by_sketch(some, cosine, need, ids, vectors, norms)

    def one_by_one(self, some: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        """For a handful of queries."""
        unit, orders = vectors / np.maximum(norms, 1e-300)[:, None], {}
        for i in some.tolist():
            rows = candidates_of(self.queries[i], self.lengths[i], self.bounds[i], unit, norms, orders, self.k)
            if rows is not None:
                chosen = np.arange(len(ids))[rows]
                self.verify(np.full(len(chosen), i), chosen, ids, vectors, norms)

    def by_coordinate(self, some, cosine, need, ids, vectors, norms) -> np.ndarray:
        """Meets the queries with a high threshold of whose largest coordinate few
        vectors are in the feasible interval; returns the others."""
        high = some[cosine[some] >= COORDINATE_FROM]
        if len(high) < COORDINATE_QUERIES:
            return some
        unit, orders, done = None, {}, []
        order = high[np.argsort(self.focus[high], kind="stable")]
        for same in np.split(order, np.flatnonzero(np.diff(self.focus[order])) + 1):
            if len(same) < COORDINATE_QUERIES:
                continue
            if unit is None:
                unit = vectors / np.maximum(norms, 1e-300)[:, None].astype(vectors.dtype)
            listed, values = sorted_by(int(self.focus[same[0]]), unit, orders)
            low, above = feasible(self.share[same], cosine[same])
            # The values are floats, so the interval is made wider than their steps.
            first = np.searchsorted(values, (low - 1e-6).astype(values.dtype), "left")
            last = np.searchsorted(values, (above + 1e-6).astype(values.dtype), "right")
            few = last - first <= len(ids) // COORDINATE_SHARE
            same, first, counts = same[few], first[few], (last - first)[few]
            if counts.sum():
                i = np.repeat(same, counts)
                j = listed[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)]
                long = norms[j] >= need[i]
                self.verify(i[long], j[long], ids, vectors, norms)
            done.append(same)
        if not done:
            return some
        left = np.zeros(len(self.bounds), dtype=bool)
        left[some] = True
        left[np.concatenate(done)] = False
        return np.flatnonzero(left)

    def by_sketch(self, some, cosine, need, ids, vectors, norms) -> None:
        """Queries and vectors scaled and rounded to small integers.  A pair's score
        less the query's threshold is a field of ``WIDTH`` bits; a matrix product in
        doubles works out ``FIELDS`` of them at a time, and everything in it is an
        integer below 2**53.  The top bit of a field tells whether the score may reach
        the threshold, which is lowered by what rounding can have taken from it.  A
        score far below it can set the bit as well, which costs a product but no
        result; one above the field's range cannot occur (``thresholds`` sees to it)."""
        turned = vectors.astype(np.float64) @ self.turn / norms[0]
        kept, below = self.leading(some, cosine, turned, norms[0])
        if not kept:
            self.dense(some, ids, vectors, norms)
            return
        queries, exact = short(self.unit[some], kept), short(turned, kept) * LENGTH
        dim, half = exact.shape[1], 1 << (WIDTH - 1)
        rounded = np.rint(exact)
        error = float(lengths_of(rounded - exact).max()) * (1 + 1e-6)
        longest = float(lengths_of(rounded).max())
        words = np.zeros((-(-len(ids) // FIELDS), dim + 1))
        words[:, dim] = 1
        for field in range(FIELDS):
            own = rounded[field::FIELDS]
            words[: len(own), :dim] += own * float(1 << WIDTH * field)
        width = max(32, min(TILE // FIELDS, len(words)))
        passed = np.zeros(TILE * width)
        folded = np.zeros(TILE * width // 2, dtype=np.uint64)
        marks = [np.uint64(half << WIDTH * field) for field in range(FIELDS)]
        mask, ones = np.bitwise_or.reduce(marks), float(sum(1 << WIDTH * field for field in range(FIELDS)))
        seen, over = 1, 0
        for at in range(0, len(some), TILE):
            # Bits are looked for in some rows at once, fewer where many are set.
            folds = 2 ** min(5, max(1, round(math.log2(0.6 * seen / max(over, 1)) / 2)))
            tile = some[at : at + TILE]
            reach = int(np.searchsorted(-norms, -need[tile].min(), "right"))
            if not reach:
                continue
            small, least = thresholds(queries[at : at + TILE], cosine[tile], error, longest, below)
            left = np.zeros((-(-len(tile) // 32) * 32, dim + 1))
            left[:, dim] = 3 << 51
            left[: len(tile), :dim] = small
            left[: len(tile), dim] += (half - least) * ones
            found = []
            for start in range(0, -(-reach // FIELDS), width):
                right = words[start : min(start + width, -(-reach // FIELDS))]
                out = passed[: len(left) * len(right)].reshape(len(left), len(right))
                np.dot(left, right.T, out=out)
                bits = passed[: out.size].view(np.uint64)
                part = out.size // 2
                any_of = np.bitwise_or(bits[:part], bits[part:], out=folded[:part])
                while part * folds > out.size:
                    part //= 2
                    any_of = np.bitwise_or(any_of[:part], any_of[part:], out=any_of[:part])
                hit = np.flatnonzero((any_of & mask) != 0)
                seen += len(tile) * len(right)
                if not len(hit):
                    continue
                place = (hit + np.arange(folds)[:, None] * part).ravel()
                which = bits[place] & mask
                place, which = place[which != 0], which[which != 0]
                row, column = np.divmod(place, len(right))
                column = FIELDS * (column + start)
                sets = [(which & mark) != 0 for mark in marks]
                row = np.concatenate([row[x] for x in sets])
                column = np.concatenate([column[x] + field for field, x in enumerate(sets)])
                inside = (row < len(tile)) & (column < reach)
                row, column = row[inside], column[inside]
                over += len(row)
                stop = min(reach, FIELDS * (start + len(right)))
                if len(row) > DENSE_FROM * len(tile) * FIELDS * len(right):
                    part = slice(FIELDS * start, stop)
                    self.dense(tile, ids[part], vectors[part], norms[part])
                elif len(row):
                    found.append(self.exact(tile[row], column, ids, vectors, norms))
            if found:
                self.add(*(np.concatenate(x) for x in zip(*found)))

    def leading(self, some: np.ndarray, cosine: np.ndarray, turned: np.ndarray, longest: float) -> tuple[int, float]:
        """How many coordinates the sketch keeps and how far below 0 its fields hold
        cosines: what costs least by some queries and vectors, counted in coordinates.
        None are kept if all products cost less."""
        dim, kind = turned.shape[1], exact_kind(longest, self.longest)
        few = some[:: -(-len(some) // 64)]
        others = turned[:: -(-len(turned) // 512)]
        costs = {(0, 1.0): math.inf if kind is None else 250 + (2 if kind is np.float32 else 6) * dim}
        for kept in {max(1, dim * part // 8) for part in range(1, 9)}:
            queries, vectors = short(self.unit[few], kept), short(others, kept)
            loss, found = math.sqrt(queries.shape[1] / 12), queries @ vectors.T
            for below in (0.45, 1.0):
                scale, least = scales(cosine[few], 1.15 * loss, loss, below)
                wrapped = least - (1 << WIDTH - 1) / (scale * LENGTH)
                passing = np.mean((found >= least[:, None]) | (found < wrapped[:, None]))
                costs[kept, below] = queries.shape[1] + 22 + (PASSED[0] + PASSED[1] * dim) * float(passing)
        return min(costs, key=costs.get)

    def verify(self, i, j, ids, vectors, norms) -> None:
        if len(i):
            self.add(*self.exact(i, j, ids, vectors, norms))

    def exact(self, i, j, ids, vectors, norms):
        """Query, score and id of those of the pairs that reach the bounds."""
        kind = exact_kind(norms[0], self.longest)
        step, parts = max(1, (1 << 22) // vectors.shape[1]), []
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            x, y = vectors.take(b, axis=0), self.queries.take(a, axis=0)
            if kind is None:
                score = np.fromiter((products(v[None], w[None])[0, 0] for v, w in zip(x, y)), dtype=np.int64, count=len(a))
            else:
                score = np.einsum("ij,ij->i", x.astype(kind, copy=False), y.astype(kind, copy=False))
            good = score >= self.bounds[a]
            a, b, score = a[good], b[good], score[good].astype(np.int64)
            parts.append((a, score, ids[b]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def dense(self, some, ids, vectors, norms) -> None:
        """All products of some queries and a block."""
        if not len(some) or not len(ids):
            return
        kind = exact_kind(norms[0], self.longest)
        by_id = np.argsort(ids, kind="stable")
        lowest = np.iinfo(np.int64).min if kind is None else OPEN_END
        for at in range(0, len(some), TILE):
            tile = some[at : at + TILE]
            queries = self.queries[tile]
            start = 0
            while start < len(ids):
                stop = min(len(ids), start + (256 if start == 0 or kind is None else TILE))
                block, numbers = vectors[start:stop], ids[start:stop]
                if kind is None:
                    scores = products(queries, block)
                else:
                    scores = queries.astype(kind, copy=False) @ block.T.astype(kind, copy=False)
                listed = by_id[(by_id >= start) & (by_id < stop)] - start
                first = np.searchsorted(numbers[listed], self.query_ids[tile], "left")
                counts = np.searchsorted(numbers[listed], self.query_ids[tile], "right") - first
                own = np.repeat(np.arange(len(tile)), counts)
                place = listed[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)]
                scores[own, place] = lowest
                bounds = self.bounds[tile]
                if len(numbers) >= self.k and (bounds == OPEN_END).any():
                    kth = np.partition(scores, len(numbers) - self.k, axis=1)[:, len(numbers) - self.k]
                    bounds = np.maximum(bounds, kth)
                hits = scores >= bounds[:, None] if kind is None else scores >= bounds.astype(kind)[:, None]
                hits[own, place] = False
                row, column = np.divmod(places(hits), len(numbers))
                if len(row):
                    self.add(tile[row], scores[row, column].astype(np.int64), numbers[column])
                start = stop

    def add(self, i: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in scores that may be among the best; ties go to the smaller id."""
        full, worst, last = self.count[i] == self.k, self.scores[i, -1], self.ids[i, -1]
        good = (ids != self.query_ids[i]) & (~full | (scores > worst) | (scores == worst) & (ids < last))
        i, scores, ids = i[good], scores[good], ids[good]
        if not len(i):
            return
        touched = np.unique(i)
        old = np.arange(self.k) < self.count[touched][:, None]
        i = np.concatenate([i, np.repeat(touched, self.count[touched])])
        scores = np.concatenate([scores, self.scores[touched][old]])
        ids = np.concatenate([ids, self.ids[touched][old]])
        order = np.lexsort((ids, ~scores, i))
        i, scores, ids = i[order], scores[order], ids[order]
        place = np.arange(len(i))
        rank = place - np.maximum.accumulate(np.where(np.diff(i, prepend=-1) != 0, place, 0))
        best = rank < self.k
        i, rank = i[best], rank[best]
        self.scores[i, rank], self.ids[i, rank] = scores[best], ids[best]
        self.count[touched] = np.bincount(i, minlength=len(self.count))[touched]
        done = touched[self.count[touched] == self.k]
        self.bounds[done] = np.maximum(self.bounds[done], self.scores[done, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = np.arange(self.k) < self.count[:, None]
        return np.repeat(self.query_ids, self.count), self.ids[there], self.scores[there]


def places(flags: np.ndarray) -> np.ndarray:
    """Where a matrix of flags is set, counted through; eight at a time are looked at."""
    flat = flags.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64) != 0)
    word, place = np.nonzero(flat.reshape(-1, 8)[words])
    return words[word] * 8 + place


def short(vectors: np.ndarray, kept: int) -> np.ndarray:
    """The first coordinates and the length of the rest in place of the others: the
    lengths stay, and no product gets smaller."""
    if kept >= vectors.shape[1] - 1:
        return vectors
    return np.column_stack([vectors[:, :kept], lengths_of(vectors[:, kept:])])


def scales(cosine: np.ndarray, error: float, loss: float, below: float) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the queries in the sketch with which a field holds every score from
    the threshold up, and below 0 those of cosines down to ``below`` (if that is
    not 1, no farther than the threshold is above 0); and about the cosine that passes."""
    scale = np.full(len(cosine), LENGTH)
    for _ in range(3):
        lowered = np.clip(cosine - 1.03 * (error / LENGTH + loss / scale), 0.02, 1.0)
        most = np.maximum(1.03 - lowered, lowered + (below if below == 1.0 else np.minimum(lowered, below)))
        scale = 0.97 * (1 << WIDTH - 1) / most / LENGTH
    return scale, lowered


def thresholds(
    unit: np.ndarray, cosine: np.ndarray, error: float, longest: float, below: float
) -> tuple[np.ndarray, np.ndarray]:
    """Queries in small integers, and the least score of a pair in the sketch that
    may have the cosine.  ``error`` is what rounding took from a vector at most and
    ``longest`` the length of the longest rounded one.  No score is above its field's
    range; few wrap below it, none twice."""
    half = 1 << (WIDTH - 1)
    scale, _ = scales(cosine, error, math.sqrt(unit.shape[1] / 12), below)
    while True:
        exact = unit * scale[:, None]
        small = np.rint(exact)
        size = lengths_of(small)
        off = lengths_of(small - exact) * (1 + 1e-6)
        least = np.floor(scale * LENGTH * (cosine - 1e-5) - size * error - off * LENGTH) - 1
        most = size * longest * (1 + 1e-9)
        wide = (most - least > half - 2) | (most + least > 3 * half - 2)
        if not wide.any():
            return small, least
        scale[wide] *= 0.9


def group_size(dim: int) -> int:
    return max(64, GROUP_VALUES // dim)


def grid(plan: list[tuple[int, int, int]], most: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Dimension, parts of the queries and of the vectors, and the number of the
    first cell; and in how many partitions the cells are dealt, one in each unless
    there are more dimensions than that."""
    out, first = [], 0
    for dim, across, down in plan:
        out.append((dim, across, down, first))
        first += across * down
    return out, max(1, min(first, 2 * most))


def dealt(queries: DataFrame, vectors: DataFrame, cells: list[tuple[int, int, int, int]], parts: int) -> DataFrame:
    """One partition per cell: the queries of its group, then its blocks, longest
    first.  Blocks that no query of a group can need are left out before they move."""
    spark = queries.sparkSession
    plan = F.broadcast(spark.createDataFrame(cells, "dim int, _across int, _down int, _first int"))
    part = F.pmod(F.col("_cell"), F.lit(parts)).cast("int").alias("_part")
    left = queries.join(plan, "dim").withColumn("_group", F.pmod("block", "_across").cast("int"))
    needed = left.groupBy("dim", "_group").agg(F.min("need").alias("_need"))
    left = left.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_down") - 1)))
    right = vectors.join(plan, "dim").withColumn("_at", F.pmod("block", "_down").cast("int"))
    right = right.withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_across") - 1)))
    right = right.join(F.broadcast(needed), ["dim", "_group"]).where("top >= _need")
    cell = (F.col("_first") + F.col("_group") * F.col("_down") + F.col("_at")).alias("_cell")
    left = left.select(cell, F.lit(0).alias("kind"), F.lit(0.0).alias("rank"), "block", "dim", "ids", "data", "bounds")
    right = right.select(cell, F.lit(1).alias("kind"), (-F.col("top")).alias("rank"), "block", "dim", "ids", "data", F.lit(None).cast("binary").alias("bounds"))
    both = left.unionByName(right).select(part, "*")
    return both.repartitionById(parts, "_part").drop("_part").sortWithinPartitions("_cell", "kind", "rank", "block")


def met(rows: Iterator[tuple], k: int, size: int) -> Iterator[tuple[list[tuple], Best]]:
    """The query blocks of each cell and the best of them among its vectors."""
    for _, members in itertools.groupby(rows, key=lambda row: row[0]):
        asked, waiting, best, dim, have = [], [], None, 0, 0

        def group() -> Best:
            ids, queries = joined([unpack(r[5], r[6], r[4]) for r in asked])
            bounds = [np.frombuffer(r[7], "<f8") if r[7] else np.full(len(r[5]) // 8, OPEN_END) for r in asked]
            return Best(ids, queries, np.concatenate(bounds), k)

        for row in members:
            if row[1] == 0:
                asked.append(row)
                continue
            if not asked:
                break
            best, dim = best or group(), row[4]
            waiting.append(unpack(row[5], row[6], dim))
            have += len(waiting[-1][0])
            if have >= min(size, max(1, BLOCK_VALUES // dim)):
                best.meet(*joined(waiting))
                waiting, have = [], 0
        if asked:
            best = best or group()
            if waiting:
                best.meet(*joined(waiting))
            yield asked, best


def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, id and score of the ``k`` best vectors for each query."""
    spark = vectors.sparkSession
    ship_package(spark)
    asked = prepared(queries, key, vector).groupBy("_id").agg(F.min("_x").alias("_x"))
    buckets = materialize(blocks(vectors, block, True, key, vector, SCALE, k))
    query_blocks = materialize(blocks(asked, query_block, False, "_id", "_x", 1))

    # The driver gets one row per dimension.
    count = lambda df, mark: df.groupBy("dim").agg(F.sum("size").alias(f"{mark}_rows"), F.count("*").alias(f"{mark}_blocks"))
    sizes = count(query_blocks, "q").join(count(buckets, "v"), "dim").orderBy("dim").collect()
    work = sum(r.q_rows * r.v_rows for r in sizes)
    cores = spark.sparkContext.defaultParallelism
    most = max(3 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = min(most, max(3 * cores, work >> 30), max(1, work >> 26))
    seed_plan, plan = [], []
    for r in sizes:
        share = math.ceil(wanted * r.q_rows * r.v_rows / work)
        least = math.ceil(r.q_rows / group_size(r.dim))
        # Queries are sent as often as vectors are cut, and the other way round.
        across = max(least, min(r.q_blocks, round(math.sqrt(share * r.q_rows / r.v_rows))))
        down = min(r.v_blocks, math.ceil(share / across))
        plan.append((r.dim, min(r.q_blocks, max(across, share // down)), down))
        seed_plan.append((r.dim, min(r.q_blocks, max(least, min(SEED_SHARE // 2, share))), 1))

    longest_first = Window.partitionBy("dim").orderBy(F.desc("top"), "block")
    ranked = buckets.select("block", "dim", "size", F.sum("size").over(longest_first).alias("_sum"), F.sum("size").over(Window.partitionBy("dim")).alias("_all"))
    enough = F.greatest(F.lit(block), F.col("_all") / SEED_SHARE, F.least(F.lit(SEED_ROWS), F.col("_all") / 8))
    chosen = ranked.where(F.col("_sum") - F.col("size") < enough).select("block")
    seeds = buckets.join(F.broadcast(chosen), "block", "left_semi")
    unbound = query_blocks.select("*", F.lit(None).cast("binary").alias("bounds"), F.lit(OPEN_END).alias("need"))

    def bounded(batches):
        names = ["block", "dim", "ids", "data", "bounds", "need"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
        for blocks_of, best in met(in_cells(batches), k, block):
            at = 0
            for row in blocks_of:
                own = slice(at, at := at + len(row[5]) // 8)
                bounds, lengths = best.bounds[own], best.lengths[own]
                open_end = (bounds <= 0) | (lengths == 0)
                need = OPEN_END if open_end.any() else float((bounds / np.maximum(lengths, 1e-300)).min() * (1 - SLACK))
                values = (row[3], row[4], row[5], row[6], bounds.astype("<f8").tobytes(), need)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)
        give_back()

    limits = "block long, dim int, ids binary, data binary, bounds binary, need double"
    bound = materialize(dealt(unbound, seeds, *grid(seed_plan, most)).mapInArrow(bounded, limits))

    def verified(batches):
        for _, best in met(in_cells(batches), k, block):
            columns = best.found()
            for at in range(0, len(columns[0]), 1 << 16):
                part = [pa.array(c[at : at + (1 << 16)], pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays(part, names=["query_id", "id", "score"])
        give_back()

    found = dealt(bound, buckets, *grid(plan, most)).mapInArrow(verified, "query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def divisible_queries(df: DataFrame, key: str = "vec_id", by: int = 50) -> DataFrame:
    """The stated query set."""
    return df.where(F.col(key) % by == 0)
