"""Token counts by a compiled finite-state transducer (operator 2).

A vocabulary whose pieces are merged in the order of their scores encodes every
prefix of a text on its own: the last piece of a prefix depends on what stands in
the few characters before it.  That makes counting a finite-state task.  A state
holds the open tail (the longest suffix that a piece may still grow from), the
last piece of each prefix of the text from whose end a piece may still grow, and
the counts of those prefixes relative to the newest; reading a character gives the next state and
the change of the count.  Transitions are compiled when first met.

A long text is cut into chunks.  The state map of a chunk takes any entering
state to the leaving state and a count: up to the first start of a word it has
to be walked from the entering state, after that it is constant.  Maps compose
associatively, so chunks are combined in a tree.

Nulls and empty texts have no tokens.  Characters outside the vocabulary count
one token per UTF-8 byte.  Control strings inside a text are ordinary text.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rosterloom.session import ship_package

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 1 << 16
MAX_STATES = 300_000
MAX_WORDS = 200_000


class State:
    __slots__ = ("tail", "pieces", "counts", "next")

    def __init__(self, tail: str, pieces: tuple, counts: tuple) -> None:
        self.tail, self.pieces, self.counts, self.next = tail, pieces, counts, {}


class StateMap(NamedTuple):
    """What a chunk does to an entering state.

    ``head`` is walked from that state.  An open chunk is nothing else.  A closed
    one then adds ``body`` and leaves in ``exit``, reached from the first start of
    a word and so the same for every entering state."""

    head: str
    body: int = 0
    exit: State | None = None


class Transducer:
    def __init__(self, scores: dict[str, float], max_states: int = MAX_STATES, max_words: int = MAX_WORDS) -> None:
        self.scores = scores
        self.max_states, self.max_words = max_states, max_words
        self.prefixes = {piece[:k] for piece in scores for k in range(1, len(piece))}
        self.root = State("", (None,), (0,))
        self.states: dict[tuple, State] = {}
        self.pairs: dict[tuple, bool] = {}
        self.words: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text, merging the best pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, place = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, place = score, i
            if best is None:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def stands(self, left: str | None, piece: str) -> bool:
        """Whether the two pieces, side by side, are encoded as just these two."""
        key = (left, piece)
        known = self.pairs.get(key)
        if known is None:
            known = self.merged((left or "") + piece) == ([piece] if left is None else [left, piece])
            if len(self.pairs) >= self.max_states:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def step(self, state: State, char: str) -> tuple[State, int]:
        """Compile one transition."""
        if char not in self.scores:
            target, change = self.root, len(char.encode())
        else:
            text = state.tail + char
            for start in range(len(text)):
                piece = text[start:]
                if piece in self.scores and self.stands(state.pieces[start], piece):
                    break
            change = state.counts[start] + 1
            kept = next((k for k in range(len(text)) if text[k:] in self.prefixes), len(text))
            starts = [k == len(text) or text[k:] in self.prefixes for k in range(kept, len(text) + 1)]
            pieces = tuple(p if on else None for p, on in zip((*state.pieces, piece)[kept:], starts))
            counts = tuple(c - change if on else 0 for c, on in zip((*state.counts, change)[kept:], starts))
            key = (text[kept:], pieces, counts)
            target = self.states.get(key)
            if target is None:
                if len(self.states) >= self.max_states:
                    self.states.clear()
                    self.root.next.clear()
                target = self.states[key] = State(*key)
        state.next[char] = target, change
        return target, change

    def walk(self, state: State, text: str) -> tuple[State, int]:
        count = 0
        for char in text:
            move = state.next.get(char)
            if move is None:
                move = self.step(state, char)
            state = move[0]
            count += move[1]
        return state, count

    def state_map(self, chunk: str) -> StateMap:
        """``chunk`` is plain text with spaces; words are its parts between them."""
        head, *words = chunk.split(" ")
        if not words:
            return StateMap(head)
        if "" in words or not head:
            return self._spaced_map(chunk)
        known, body = self.words, 0
        for text in words[:-1]:
            count = known.get(text)
            body += count if count is not None else self._cold(text)
        state, count = self.walk(self.root, SPACE + words[-1])
        return StateMap(head, body + count, state)

    def _cold(self, text: str) -> int:
        count = self.walk(self.root, SPACE + text)[1]
        if len(text) <= 40:
            if len(self.words) >= self.max_words:
                self.words.clear()
            self.words[text] = count
        return count

    def _spaced_map(self, chunk: str) -> StateMap:
        """The same for runs of spaces: a word starts where a space follows
        something else; what comes before the first start is the head."""
        text = chunk.replace(" ", SPACE)
        start = next((i for i in range(1, len(text)) if text[i] == SPACE != text[i - 1]), None)
        if start is None:
            return StateMap(text)
        state, count = self.walk(self.root, text[start:])
        return StateMap(text[:start], count, state)

    def compose(self, first: StateMap, second: StateMap) -> StateMap:
        """The map of two neighbouring chunks."""
        if first.exit is None:
            return second._replace(head=first.head + second.head)
        state, count = self.walk(first.exit, second.head)
        if second.exit is None:
            return StateMap(first.head, first.body + count, state)
        return StateMap(first.head, first.body + count + second.body, second.exit)

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ") if SPACE in text else text
        maps = [self.state_map(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)]
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[len(maps) & ~1 :]
        whole = maps[0]
        count = self.walk(self.root, SPACE + whole.head.replace(" ", SPACE))[1]
        return count + whole.body


@functools.lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """The transducer of a model file, once per Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        i
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return Transducer({model.id_to_piece(i): model.get_score(i) for i in plain})


def count_tokens(
    df: DataFrame, text: str = "text", name: str = "n_tokens", path: str | None = None, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """Add the token count of each text; no shuffle, other columns stay."""
    ship_package(df.sparkSession)
    path = path or public_tokenizers.path(MODEL)

    @F.pandas_udf(LongType())
    def counted(texts):
        machine = load(path)
        return texts.map(lambda value: machine.count(value, chunk_chars) if value else 0).astype("int64")

    return df.withColumn(name, counted(F.coalesce(F.col(text), F.lit(""))))
