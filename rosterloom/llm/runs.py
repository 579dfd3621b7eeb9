"""Periodic runs of words, found in a grammar (operator 11).

A run is a stretch of words whose smallest period ``q`` repeats at least four
times (and which has at least six words) and which no neighbouring word extends.

Each text becomes a grammar by Re-Pair: in rounds, the pairs of neighbouring
symbols that occur most often give way to new symbols; a place is replaced where
its pair outranks those that overlap it, which is what replacing one pair after
the other comes to there.  When no pair repeats, the symbols that are left are
paired evenly up to one root.  A run lies across the boundary of exactly one
lowest node of the derivation, so runs are looked for once per symbol, around its
boundary, and moved to all places the symbol derives.  Pieces of a run that
smaller symbols hold are contained in the whole one and go when intervals of the
same period are merged.

Many texts share one set of arrays, each with its own symbols.  Time is
``O(n log n)`` for a text of n words, apart from texts made of long stretches
that almost repeat; memory is about 200 bytes a word of the batch or of the
longest text.

Words are what stands between blanks, tabs and line ends (ASCII).  Null texts
and texts without words have no runs and collapse to the empty text.  Rows are
independent, so rows that repeat a key keep their own results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import code, map_rows

EXPONENT = 4
LEAST_WORDS = 6
ROUNDS = 64
BATCH_WORDS = 200_000
BATCH_PERIODS = 2_000_000

Run = tuple[int, int, int]


class Grammar:
    """Nodes (first place, length and length of the left part) of derivations of
    numbered words, and the places of each node.  ``bounds`` are the first places
    of the texts and the end of the last one; words of different texts differ."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray) -> None:
        self.words = len(words)
        self.nodes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.made = 0
        last = np.zeros(len(words), dtype=bool)
        last[bounds[1:][np.diff(bounds) > 0] - 1] = True
        self.pair_evenly(*self.replace_pairs(words.copy(), last))

    def add(self, at: np.ndarray, left: np.ndarray, right: np.ndarray, node: np.ndarray, first: np.ndarray) -> np.ndarray:
        """New symbols with all their places; ``node`` numbers them from 0 and
        ``first`` holds the index of one place of each.  Gives their symbols."""
        self.nodes.append(np.stack([at[first], left[first] + right[first], left[first]]))
        self.places.append(np.stack([node + self.made, at]))
        symbols = node + (self.words + self.made)
        self.made += len(first)
        return symbols

    def replace_pairs(self, symbols: np.ndarray, last: np.ndarray):
        at, size = np.arange(len(symbols)), np.ones(len(symbols), dtype=np.int64)
        live = ~last  # places whose pair may still occur twice
        for _ in range(ROUNDS):
            pairs = np.flatnonzero(live)
            marks = symbols[pairs] * (self.words + self.made) + symbols[pairs + 1]
            _, kind, times = np.unique(marks, return_inverse=True, return_counts=True)
            often = times[kind] > 1
            live[pairs[~often]] = False
            pairs, kind = pairs[often], kind[often]
            if not len(pairs):
                break
            rank = np.empty(len(times), dtype=np.int64)
            rank[np.lexsort((_spread(len(times)), times))] = np.arange(len(times))
            order = np.full(len(symbols), -1)
            order[pairs] = rank[kind]
            chosen = _peaks(order)
            _, first, node = np.unique(order[chosen], return_index=True, return_inverse=True)
            left, right = size[chosen], size[chosen + 1]
            symbols[chosen] = self.add(at[chosen], left, right, node, first)
            size[chosen] = left + right
            last[chosen] = last[chosen + 1]
            live[chosen] = True
            live[chosen[chosen > 0] - 1] = True
            keep = np.ones(len(symbols), dtype=bool)
            keep[chosen + 1] = False
            symbols, at, size, last, live = symbols[keep], at[keep], size[keep], last[keep], live[keep]
            live &= ~last
        return at, size, last

    def pair_evenly(self, at: np.ndarray, size: np.ndarray, last: np.ndarray) -> None:
        while not last.all():
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            inside = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            chosen = np.flatnonzero((inside % 2 == 0) & ~last)
            left, right = size[chosen], size[chosen + 1]
            every = np.arange(len(chosen))
            self.add(at[chosen], left, right, every, every)
            size[chosen] = left + right
            last[chosen] = last[chosen + 1]
            keep = np.ones(len(at), dtype=bool)
            keep[chosen + 1] = False
            at, size, last = at[keep], size[keep], last[keep]


def _spread(n: int) -> np.ndarray:
    """Breaks ties between equally frequent pairs in no order of place, so that
    many of them are replaced in one round."""
    return (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)


def _peaks(order: np.ndarray) -> np.ndarray:
    """Places whose pair outranks both overlapping ones; of overlapping pairs of
    one symbol, every second."""
    starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
    value = order[starts]
    before, after = np.concatenate([[-1], value[:-1]]), np.concatenate([value[1:], [-1]])
    top = (value >= 0) & (value > before) & (value > after)
    lengths = np.diff(np.append(starts, len(order)))
    inside = np.arange(len(order)) - np.repeat(starts, lengths)
    return np.flatnonzero(np.repeat(top, lengths) & (inside % 2 == 0))


def _matching(words: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in [low, high) with this period."""
    step, right = 64, at + 1
    while right + period < high:
        stop = min(right + step, high - period)
        differs = np.flatnonzero(words[right:stop] != words[right + period : stop + period])
        if len(differs):
            right += int(differs[0])
            break
        right, step = stop, step * 4
    step, left = 64, at
    while left > low:
        stop = max(left - step, low)
        differs = np.flatnonzero(words[stop:left] != words[stop + period : left + period])
        if len(differs):
            left = stop + int(differs[-1]) + 1
            break
        left, step = stop, step * 4
    return left, right + period


def _candidates(words: np.ndarray, nodes: np.ndarray) -> Iterator[np.ndarray]:
    """Node, period, a matching place, and the node's ends and boundary, in
    ascending order of node and period: a run across a boundary has two periods
    to its right or to its left."""
    wide = np.flatnonzero(nodes[1] >= LEAST_WORDS)
    tried = np.maximum(1, nodes[1][wide] // EXPONENT)
    ends = np.cumsum(tried)
    first = 0
    while first < len(wide):
        done = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, done + BATCH_PERIODS)))
        times = tried[first:stop]
        node = np.repeat(wide[first:stop], times)
        period = np.arange(1, len(node) + 1) - np.repeat(ends[first:stop] - times - done, times)
        low = nodes[0][node]
        high, cut = low + nodes[1][node], low + nodes[2][node]

        def equal(kept: np.ndarray, place: np.ndarray) -> np.ndarray:
            return kept[words[place[kept]] == words[place[kept] + period[kept]]]

        right = np.flatnonzero((cut + 2 * period <= high) & (cut > low))
        for place in (cut, cut - 1, cut + period - 1):
            right = equal(right, place)
        left = np.flatnonzero(cut - 2 * period >= low)
        for place in (cut - period, cut - period - 1, cut - 2 * period):
            left = equal(left, place)
        both = np.concatenate([right, left])
        place = np.concatenate([cut[right], cut[left] - period[left]])
        order = np.lexsort((period[both], node[both]))
        both = both[order]
        yield np.stack([node[both], period[both], place[order], low[both], high[both], cut[both]])
        first = stop


def _runs_of_nodes(words: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Node, start, end and period of each run that crosses the node's boundary,
    as far as the node reaches, at the node's first place."""
    found, seen, at_node = [], [], -1
    for part in _candidates(words, nodes):
        for node, period, place, low, high, cut in part.T.tolist():
            if node != at_node:
                at_node, seen = node, []
            # Inside a run, a multiple of its period spans the same stretch.
            if any(period % p == 0 and s <= place and place + period < e for s, e, p in seen):
                continue
            start, end = _matching(words, place, period, low, high)
            if start < cut < end and end - start >= max(LEAST_WORDS, EXPONENT * period):
                seen.append((start, end, period))
                found.append((node, start, end, period))
    return np.array(found, dtype=np.int64).reshape(-1, 4).T


def _everywhere(found: np.ndarray, nodes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Start, end and period of the runs at all places that their node derives."""
    order = np.argsort(places[0], kind="stable")
    times = np.bincount(places[0], minlength=nodes.shape[1])
    first = np.cumsum(times) - times
    node, start, end, period = found
    copies = times[node]
    which = np.repeat(np.arange(len(node)), copies)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
    shift = places[1][order[first[node[which]] + nth]] - nodes[0][node[which]]
    return np.stack([start[which] + shift, end[which] + shift, period[which]])


def _maximal(pieces: np.ndarray) -> np.ndarray:
    """Merge pieces of one period: a whole run is among them and holds the rest."""
    start, end, period = pieces
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.concatenate([[False], period[1:] != period[:-1]]))
    reach = end + group * (int(end.max()) + 1)
    before = np.concatenate([[-1], np.maximum.accumulate(reach)[:-1]])
    return np.stack([start, end, period])[:, reach > before]


def find_runs(texts: Sequence[Sequence]) -> list[list[Run]]:
    """Start, length and period of the runs of each sequence of words, by start
    and then period."""
    bounds = np.cumsum([0, *map(len, texts)])
    result: list[list[Run]] = [[] for _ in texts]
    words = np.empty(bounds[-1], dtype=np.int64)
    for low, high, text in zip(bounds[:-1].tolist(), bounds[1:].tolist(), texts):
        numbers: dict = {}  # a word's number is the place where its text has it first
        words[low:high] = np.fromiter(map(numbers.setdefault, text, count(low)), dtype=np.int64, count=high - low)
    grammar = Grammar(words, bounds)
    if not grammar.nodes:
        return result
    nodes, places = np.concatenate(grammar.nodes, axis=1), np.concatenate(grammar.places, axis=1)
    found = _runs_of_nodes(words, nodes)
    if not found.size:
        return result
    start, end, period = _maximal(_everywhere(found, nodes, places))
    text = np.searchsorted(bounds, start, side="right") - 1
    order = np.lexsort((period, start))
    for t, s, length, p in np.stack([text, start - bounds[text], end - start, period])[:, order].T.tolist():
        result[t].append((s, length, p))
    return result


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``runs`` (start, length and period in words, numbered from 0;
    by start and then period) and ``collapsed``, the text without the words that
    repeat.  No shuffle."""

    def searched(rows: Iterable[tuple]) -> Iterator[tuple]:
        held, texts, size = [], [], 0

        def solved():
            for i, words, runs in zip(held, texts, find_runs(texts)):
                yield i, [{"start": s, "length": n, "period": p} for s, n, p in runs], collapsed(words, runs).decode()

        for i, value in rows:
            words = value.encode().split()
            if size and size + len(words) > BATCH_WORDS:
                yield from solved()
                held, texts, size = [], [], 0
            held.append(i)
            texts.append(words)
            size += len(words)
        yield from solved()

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("_key"), code(F.col(text)).alias("_text"))
    shape = f"`{key}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_rows(source, ["_key", "_text"], searched, shape)
