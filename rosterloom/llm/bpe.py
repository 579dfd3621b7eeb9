"""Byte-pair encoding and decoding (operator 10).

A word is a doubly linked list of symbols.  Every neighbouring pair that has a
merge waits in a priority queue, ordered by the merge's rank and then by place.
Popping an entry merges its pair and queues the pairs the new symbol makes; an
entry whose symbols have changed meanwhile is stale and skipped.  Decoding looks
up the string of each id and joins them.

The vocabulary file says what a word is: NFC, runs of white space as one blank,
lower case letter by letter, then the file's split pattern; bytes stand for
themselves as printable letters, and the last symbol of a word carries the end
mark.  Special strings inside a text become their own ids, before all that.

Nulls and empty texts give no ids and decode to the empty text.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array
from typing import NamedTuple

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import Recent, code, map_rows

FILE = "word_bpe_49k.json"
MAX_WORDS = 250_000


class Word(NamedTuple):
    ids: bytes
    text: str


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints in
    Latin-1, else the next free letter from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.bits = max(self.strings).bit_length()
        #: Two neighbouring ids, in one number, to the rank of their merge and the new id.
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault(vocab[left] << self.bits | vocab[right], rank << self.bits | vocab[left + right])
        end = model["end_of_word_suffix"] or ""
        self.letters = [vocab.get(letter) for letter in byte_letters()]
        self.last_letters = [vocab.get(letter + end) for letter in byte_letters()]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        splitter = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(splitter["pattern"]["Regex"]).findall
        self.words = Recent(self.word, MAX_WORDS)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to one word's symbols.  A queue entry is a merge and
        a place; it is stale if the pair at that place has another merge by now."""
        n, bits = len(symbols), self.bits
        merge_of = self.merges.get
        merge = [merge_of(a << bits | b, -1) for a, b in zip(symbols, symbols[1:])]
        queue = [m << 32 | i for i, m in enumerate(merge) if m >= 0]
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push, new_id = heapq.heappop, heapq.heappush, (1 << bits) - 1
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            if merge[i] != entry >> 32:
                continue
            j = after[i]
            k, m = before[i], after[j]
            symbols[i] = own = (entry >> 32) & new_id
            symbols[j] = -1
            after[i] = m
            merge[i] = -1
            if j < n - 1:
                merge[j] = -1
            if m < n:
                before[m] = i
                merge[i] = found = merge_of(own << bits | symbols[m], -1)
                if found >= 0:
                    push(queue, found << 32 | i)
            if k >= 0:
                merge[k] = found = merge_of(symbols[k] << bits | own, -1)
                if found >= 0:
                    push(queue, found << 32 | k)
        return [s for s in symbols if s >= 0]

    def word(self, text: str) -> Word:
        letters, packed = self.letters, text.encode()
        symbols = [letters[b] for b in packed]
        symbols[-1] = self.last_letters[packed[-1]]
        ids = self.merge(symbols)
        return Word(array("I", ids).tobytes(), self.decode(ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text they decode to.  No
        word holds white space, so runs of it need not be replaced before the split."""
        found: list[Word] = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                i = self.special[part]
                found.append(Word(array("I", [i]).tobytes(), self.strings[i]))
                continue
            part = unicodedata.normalize("NFC", part)
            lowered = (part.replace("Σ", "σ") if "Σ" in part else part).lower()
            found += map(self.words.__getitem__, self.words_of(lowered))
        return b"".join([ids for ids, _ in found]), " ".join([text for _, text in found])

    def decode(self, ids) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Codec:
    return Codec(path)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: key, ``ids`` (little-endian unsigned 32-bit integers, packed),
    ``n_tokens`` and ``decoded``.  Rows are independent: no shuffle."""
    path = path or public_tokenizers.path(FILE)

    def encoded(rows):
        codec = load(path)
        for i, value in rows:
            ids, decoded = codec.encode(value)
            yield i, ids, len(ids) // 4, decoded

    kind = df.schema[key].dataType.simpleString()
    return map_rows(
        df.select(F.col(key).alias("_key"), code(F.col(text)).alias("_text")),
        ["_key", "_text"],
        encoded,
        f"`{key}` {kind}, ids binary, n_tokens bigint, decoded string",
    )


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """The text of packed ids, by joining vocabulary strings; null ids decode to
    the empty text, ids outside the vocabulary to nothing."""
    path = path or public_tokenizers.path(FILE)

    def decoded(rows):
        codec = load(path)
        for i, packed in rows:
            numbers = array("I", packed or b"")
            yield i, codec.decode([n for n in numbers if n in codec.strings])

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df, [key, ids], decoded, f"`{key}` {kind}, decoded string")
