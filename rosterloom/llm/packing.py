"""Best-fit packing by minimum bin slack (operator 7).

Documents become token ids with an end mark; one that is longer than a sequence
is cut into full pieces, the first of which takes the remainder.  Which lengths
share a sequence depends only on how many pieces there are of each length, and
there are at most ``capacity`` lengths: the plan is made from that histogram.
For each sequence the longest piece left is placed, and a bitset subset-sum over
the lengths left finds the fullest combination for the rest; that combination is
taken as often as the counts allow.  Each piece then gets its place from its rank
among the pieces of its length, so pieces are never gathered anywhere.

A null text is empty and gives one piece, the end mark.  Rows that repeat a
doc_id are packed each on its own.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import sys
import zlib
from array import array
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterloom.llm.common import Recent, code, map_rows, materialize

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
MAX_WORDS = 50_000
CHUNKS = 4096
LONG_BLANKS = re.compile(r"\s{5000}")


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers.  An array of the standard library takes
    a short list at a fraction of the cost of a numpy one."""
    out = array("I", ids)
    if out.itemsize != 4 or sys.byteorder != "little":
        return np.array(ids, dtype="<u4").tobytes()
    return out.tobytes()


class Encoder:
    """Token ids of whole texts.

    A blank between two characters that are no white space always starts a new
    part, so the ids of a text are those of its words side by side; only words
    not met before are encoded.  Any other text is encoded as a whole.  The rank
    file holds the same vocabulary as the other and gives the same ids."""

    def __init__(self, vocabulary: str, ranks: str) -> None:
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        with open(vocabulary, encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.vocabulary = vocabulary
        self.fast = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special
        )
        self.words = Recent(self.behind_blank, MAX_WORDS)

    def behind_blank(self, word: str) -> bytes | None:
        """Packed ids of a blank followed by a word; None where the word touches
        other white space, as its ids then depend on its neighbours."""
        if not word or word[0].isspace() or word[-1].isspace() or "<|" in word:
            return None
        return packed(self.fast.encode_ordinary(" " + word))

    @functools.cached_property
    def whole(self):
        """The library's own encoder, loaded only where a text needs it."""
        import tokenizers

        found = tokenizers.Tokenizer.from_file(self.vocabulary)
        found.no_truncation()
        found.no_padding()
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        long_blanks = LONG_BLANKS.search(text)  # the fast pattern engine has a limited stack
        first, *rest = text.split(" ")
        if not long_blanks and first and "<|" not in first and not first[0].isspace() and not first[-1].isspace():
            try:
                tail = b"".join(map(self.words.__getitem__, rest))
            except TypeError:
                pass
            else:
                return packed(self.fast.encode_ordinary(first)) + tail
        if long_blanks:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode(text, allowed_special="all")
        return packed(ids)


@functools.lru_cache(maxsize=2)
def load(vocabulary: str, ranks: str) -> Encoder:
    return Encoder(vocabulary, ranks)


def token_pieces(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """Key, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, the
    packed ``ids`` of every piece of every document."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    ranks = ranks or public_tokenizers.path(RANKS)
    mark = np.array([end], dtype="<u4").tobytes()

    def pieces(rows):
        encoder = load(vocabulary, ranks)
        for i, value in rows:
            ids = encoder.encode(value) + mark
            total = len(ids) // 4
            start, length = 0, (total - 1) % capacity + 1
            for number in range((total + capacity - 1) // capacity):
                part = ids[4 * start : 4 * (start + length)]
                row = (i, number, start, length, zlib.crc32(part))
                yield (*row, part) if with_ids else row
                start, length = start + length, capacity

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return map_rows(df.select(F.col(key).alias("_key"), code(F.col(text)).alias("_text")), ["_key", "_text"], pieces, schema)


class Pattern(NamedTuple):
    """So many sequences hold these lengths, each so many times."""

    lengths: list[tuple[int, int]]
    sequences: int


def fullest(lengths: list[int], counts: dict[int, int], slack: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the largest sum up to ``slack``.

    ``reach`` is a bitset of the sums that can be made; it is extended length by
    length, longest first, and each stage is kept to read the combination back."""
    mask, reach = (1 << (slack + 1)) - 1, 1
    stages: list[tuple[int, int]] = []
    for length in lengths:
        if length > slack:
            continue
        for _ in range(min(counts[length], slack // length)):
            stages.append((length, reach))
            reach |= reach << length & mask
        if reach >> slack & 1:
            break
    left, taken = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        if not before >> left & 1:
            left -= length
            taken[length] = taken.get(length, 0) + 1
    return sorted(taken.items(), reverse=True)


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Minimum bin slack over a histogram of piece lengths."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    patterns = []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        filling = dict(fullest(lengths, counts, capacity - longest))
        counts[longest] += 1
        filling[longest] = filling.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in filling.items())
        for length, n in filling.items():
            counts[length] -= n * times
        patterns.append(Pattern(sorted(filling.items(), reverse=True), times))
        lengths = [length for length in lengths if counts[length]]
    return patterns


def ranked(pieces: DataFrame, identity: list[str]) -> DataFrame:
    """Add ``rank`` from 0 within each length.  Ranks are counted within chunks
    and moved by the sizes of the chunks before, so that a length which most
    pieces share is spread over all chunks."""
    chunked = pieces.withColumn("_chunk", F.pmod(F.xxhash64(*identity), F.lit(CHUNKS)))
    sizes = chunked.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy(*identity)) - 1
    joined = chunked.withColumn("_inside", inside).join(starts, ["length", "_chunk"])
    return joined.withColumn("rank", F.col("_before") + F.col("_inside")).drop("_chunk", "_before", "_inside")


def pack(pieces: DataFrame, identity: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length``.

    ``identity`` tells pieces apart; pieces equal in it may swap places.  The
    driver gets one count per length, at most ``capacity`` of them, and sends the
    plan back, whose size depends on ``capacity`` alone."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    used = dict.fromkeys(histogram, 0)
    steps: dict[int, list[tuple[int, int, int, int]]] = {length: [] for length in histogram}
    base = 0
    for pattern in plan_sequences(histogram, capacity):
        offset = 0
        for length, n in pattern.lengths:
            steps[length].append((used[length], pattern.sequences, base, offset))
            used[length] += n * pattern.sequences
            offset += length * n
        base += pattern.sequences
    tables = {length: np.array(rows, dtype=np.int64) for length, rows in steps.items()}

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.empty((len(lengths), 2), dtype=np.int64)
        for value in np.unique(lengths):
            at = lengths == value
            plan = tables[value]
            first, times, start, offset = plan[np.searchsorted(plan[:, 0], ranks[at], "right") - 1].T
            copy, turn = np.divmod(ranks[at] - first, times)
            out[at] = np.stack([start + turn, offset + copy * value], axis=1)
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    placed = ranked(pieces, identity).withColumn("_place", place("length", "rank"))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids of each sequence, of at most ``capacity`` tokens each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"))


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize once, then place: the narrow pieces are kept in the shared folder."""
    pieces = materialize(token_pieces(df, key, text, capacity))
    return pack(pieces, [key, "piece", "start", "ids_crc32"], capacity)
