"""Ranked lexical search over a length-stratified index (operator 13).

The score of a document for a query sums, over the query's terms with repeats,
the term's weight times ``(10**9 * tf) div (1000 * tf + 12 * m)``, where ``m``
normalises the document's length.  Documents with the same ``m`` are a stratum:
there the impact depends on ``tf`` alone and is worked out once per ``tf``.

The index is sharded by document, so that no posting is shuffled and no term or
length is hot: every task sorts its documents by ``m`` and reads them in windows of
a bounded number of postings.  A stratum's largest ``tf`` of each term bounds its
score for every query; strata are visited in the order of their bounds, and only
for queries whose worst kept result the bound can still reach.  A task yields its
best results per query, which are merged in two steps.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII,
with only A-Z lower-cased.  Queries are read in blocks: a block's queries times
its terms are at most ``CELLS`` (or it is one query), which bounds what is
broadcast; the index holds the terms of the block.  Statistics cover all
documents.

Null texts have no terms; a query without terms, or without a document that
scores above 0, has no results.  Equal scores go by ascending key, nulls last.
Rows that repeat a key, of documents or of queries, are rows of their own; as the
results carry keys only, those of repeated query keys cannot be told apart.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterloom.llm.common import code, map_rows, map_stream, materialize

BEST = 20
CELLS = 2_000_000
POSTINGS = 1_000_000
LOT = 512
BUCKETS = 64

#: Letters and digits stand for themselves, bytes of longer characters too; the rest parts terms.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def query_blocks(queries: DataFrame, key: str, text: str, cells: int = CELLS) -> Iterator[list[tuple[object, Counter]]]:
    """Keys and term counts of queries that have terms, in blocks of bounded size."""
    block: list[tuple[object, Counter]] = []
    known: set[bytes] = set()
    for row in queries.select(F.col(key).alias("k"), code(F.col(text)).alias("t")).toLocalIterator():
        counts = Counter(terms_of(row["t"]))
        if not counts:
            continue
        if block and (len(block) + 1) * len(known | counts.keys()) > cells:
            yield block
            block, known = [], set()
        block.append((row["k"], counts))
        known |= counts.keys()
    if block:
        yield block


def index_terms(df: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``_key``, ``n`` (its terms with repeats), and the numbers and
    frequencies of the terms it has of the vocabulary, packed."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def indexed(rows):
        number = shared.value.get
        for i, value in rows:
            terms = terms_of(value)
            held = np.array([t for t in map(number, terms) if t is not None], dtype=np.int32)
            held, times = np.unique(held, return_counts=True)
            yield i, len(terms), held.tobytes(), times.astype(np.int32).tobytes()

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("_key"), code(F.col(text)).alias("_text"))
    return map_rows(source, ["_key", "_text"], indexed, f"_key {kind}, n bigint, terms binary, times binary")


def document_counts(index: DataFrame, size: int) -> np.ndarray:
    """In how many rows each term of the vocabulary is."""

    def counted(rows):
        total = np.zeros(size, dtype=np.int64)
        for (terms,) in rows:
            total[np.frombuffer(terms, dtype=np.int32)] += 1
        yield from ((t, int(total[t])) for t in np.flatnonzero(total).tolist())

    partial = map_stream(index.where("length(terms) > 0"), ["terms"], counted, "term int, df bigint")
    result = np.zeros(size, dtype=np.int64)
    for row in partial.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        result[row["term"]] = row["df"]
    return result


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Searcher:
    """Best results of one task's documents for a block of queries."""

    def __init__(self, weights: np.ndarray, best: int) -> None:
        # Products of doubles are exact below 2**53, and an impact is below 10**6.
        exact = weights.sum(axis=1).max() * 1e6 < 2**53
        self.weights = weights.astype(np.float64 if exact else np.int64)
        self.best = best
        self.kept: list[list[tuple]] = [[] for _ in weights]
        self.least = np.ones(len(weights))

    def window(self, rows: list[tuple]) -> None:
        """Rows hold key, m, terms and frequencies and are sorted by m."""
        size = self.weights.shape[1]
        terms = [np.frombuffer(r[2], dtype=np.int32) for r in rows]
        document = np.repeat(np.arange(len(rows)), [len(t) for t in terms])
        term = np.concatenate(terms)
        norm = np.array([r[1] for r in rows], dtype=np.int64)
        tf = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.int32).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], norm[1:] != norm[:-1]]))
        stratum = np.cumsum(np.concatenate([[False], norm[1:] != norm[:-1]]))
        # One impact per stratum and frequency.
        (of, times), place = self.pairs(stratum[document], tf)
        impact = ((1_000_000_000 * times) // (1000 * times + 12 * norm[first][of]))[place]
        postings = np.searchsorted(document, np.append(first, len(rows)))
        step = max(1, CELLS // size)
        bounds = np.concatenate([
            self.bounds(stratum, document, term, impact, postings, low, min(low + step, len(first)))
            for low in range(0, len(first), step)
        ])
        starts = np.append(first, len(rows))
        at = np.searchsorted(document, np.arange(len(rows) + 1))
        lot: list[int] = []
        held = 0
        visits = np.argsort(-bounds.max(axis=1), kind="stable").tolist()
        for s in visits:
            lot.append(s)
            held += starts[s + 1] - starts[s]
            if held >= LOT or s == visits[-1]:
                self.visit(np.concatenate([np.arange(starts[x], starts[x + 1]) for x in lot]), bounds[lot].max(axis=0), rows, at, term, impact)
                lot, held = [], 0

    @staticmethod
    def pairs(stratum: np.ndarray, tf: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        codes, place = np.unique(stratum << 32 | tf, return_inverse=True)
        return (codes >> 32, codes & 0xFFFFFFFF), place

    def bounds(self, stratum, document, term, impact, postings, low: int, high: int) -> np.ndarray:
        part = slice(postings[low], postings[high])
        most = np.zeros((high - low, self.weights.shape[1]), dtype=self.weights.dtype)
        np.maximum.at(most, (stratum[document[part]] - low, term[part]), impact[part].astype(most.dtype))
        return most @ self.weights.T

    def visit(self, documents: np.ndarray, bound: np.ndarray, rows: list[tuple], at, term, impact) -> None:
        """Score documents for the queries whose bound reaches the worst kept result."""
        active = np.flatnonzero(bound >= self.least)
        step = max(1, CELLS // self.weights.shape[1])
        for first in range(0, len(documents) if len(active) else 0, step):
            part = documents[first : first + step]
            sizes = at[part + 1] - at[part]
            row = np.repeat(np.arange(len(part)), sizes)
            posting = np.arange(len(row)) + np.repeat(at[part] - np.cumsum(sizes) + sizes, sizes)
            dense = np.zeros((len(part), self.weights.shape[1]), dtype=self.weights.dtype)
            dense[row, term[posting]] = impact[posting]
            scores = dense @ self.weights[active].T
            for column, query in enumerate(active.tolist()):
                self.keep(query, scores[:, column], part, rows)

    def keep(self, query: int, scores: np.ndarray, documents: np.ndarray, rows: list[tuple]) -> None:
        good = np.flatnonzero(scores >= self.least[query])
        if len(good) > self.best:
            own = scores[good]
            good = good[own >= np.partition(own, -self.best)[-self.best]]
        if len(good):
            found = [(int(scores[i]), rows[documents[i]][0]) for i in good.tolist()]
            kept = sorted(self.kept[query] + found, key=lambda f: (-f[0], f[1] is None, f[1] if f[1] is not None else 0))[: self.best]
            self.kept[query] = kept
            if len(kept) == self.best:
                self.least[query] = max(1, kept[-1][0])


def search_block(index: DataFrame, block: list[tuple[object, Counter]], vocabulary: dict[bytes, int], best: int) -> DataFrame:
    """Query number in the block, key and score of each task's best documents."""
    totals = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    documents, all_terms = totals["documents"] or 0, totals["terms"] or 0
    holding = document_counts(index, len(vocabulary))
    weights = np.zeros((len(block), len(vocabulary)), dtype=np.int64)
    for number, (_, counts) in enumerate(block):
        for term, times in counts.items():
            weights[number, vocabulary[term]] = times * weight(documents, int(holding[vocabulary[term]]))
    shared = index.sparkSession.sparkContext.broadcast(weights)
    norm = F.expr(f"100 - 25 + (25 * n * {documents}L) div {max(1, all_terms)}L")

    def searched(rows: Iterable[tuple]) -> Iterator[tuple]:
        searcher = Searcher(shared.value, best)
        window, postings = [], 0
        for row in rows:
            window.append(row)
            postings += len(row[2]) // 4
            if postings >= POSTINGS:
                searcher.window(window)
                window, postings = [], 0
        if window:
            searcher.window(window)
        for query, kept in enumerate(searcher.kept):
            yield from ((query, key, score) for score, key in kept)

    kind = index.schema["_key"].dataType.simpleString()
    strata = index.where("length(terms) > 0").withColumn("m", norm).sortWithinPartitions("m")
    return map_stream(strata, ["_key", "m", "terms", "times"], searched, f"query int, _key {kind}, score bigint")


def search(
    queries: DataFrame,
    documents: DataFrame,
    query_key: str = "item_id",
    query_text: str = "text",
    key: str = "doc_id",
    text: str = "text",
    best: int = BEST,
) -> DataFrame:
    """Query key, ``rank`` from 1, document key and ``score`` of each query's best
    documents."""
    spark = documents.sparkSession
    query_kind = queries.schema[query_key].dataType.simpleString()
    kind = documents.schema[key].dataType.simpleString()
    result = spark.createDataFrame([], f"`{query_key}` {query_kind}, rank int, `{key}` {kind}, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("_key")]
    for block in query_blocks(queries, query_key, query_text):
        vocabulary = {term: i for i, term in enumerate(sorted({t for _, counts in block for t in counts}))}
        index = materialize(index_terms(documents, vocabulary, key, text))
        found = search_block(index, block, vocabulary, best)
        # Two steps, as each task of a large input has its own best results.
        bucket = F.pmod(F.xxhash64("_key"), F.lit(BUCKETS))
        place = F.row_number().over(Window.partitionBy("query", "_bucket").orderBy(*order))
        found = found.withColumn("_bucket", bucket).withColumn("rank", place).where(F.col("rank") <= best).drop("rank", "_bucket")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= best)
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], f"query int, _name {query_kind}")
        named = found.join(F.broadcast(names), "query")
        result = result.unionByName(named.select(F.col("_name").alias(query_key), "rank", F.col("_key").alias(key), "score"))
    return result
