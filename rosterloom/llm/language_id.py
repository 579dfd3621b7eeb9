"""Language by segmentation-marginalised unigrams (operator 5).

Every language has its own probabilities over the pieces of a fixed public
vocabulary.  A word's probability is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words.  The
probabilities are fitted by expectation maximization on the word counts of a
bounded sample of labelled texts.

Words are the runs of letters of the lower-cased text.  A text that is null or
has no letter gets ``und`` and score 0.  So does every text if nothing was
learned.  Ties go to the language that sorts first.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import code, map_rows

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
MAX_DOCS_PER_LANGUAGE = 400
ROUNDS = 3
SMOOTHING = 0.05
UNKNOWN = 1e-7
LONG_WORD = 48
WINDOW = 4096
MAX_WORDS = 300_000
BATCH_CHARS = 400_000


class Lattice:
    """All ways to cut words into pieces, as arcs from a place to a later one.

    The pieces are a trie whose steps, a state and a letter in one number, are
    sorted; all places of all words walk it at once."""

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces) + 1  # the last number is that of an unknown letter
        self.longest = max(map(len, pieces))
        steps: dict[int, int] = {}
        held = {0: -1}
        for number, piece in enumerate(pieces):
            state = 0
            for char in piece:
                state = steps.setdefault(state << 21 | ord(char), len(steps) + 1)
                held.setdefault(state, -1)
            held[state] = number
        self.steps = np.array(sorted(steps), dtype=np.int64)
        self.next = np.array([steps[k] for k in self.steps.tolist()], dtype=np.int64)
        self.piece = np.array([held[state] for state in range(len(held))], dtype=np.int64)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of each arc, ordered by end."""
        return self.arcs_in([START + word for word in words])

    def arcs_in(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        word = np.repeat(np.arange(len(texts)), sizes)
        start = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - start
        unknown = np.ones(len(codes), dtype=bool)
        at, state, found = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), []
        for depth in range(self.longest):
            if depth:
                more = left[at] > depth
                at, state = at[more], state[more]
            step = state << 21 | codes[at + depth]
            place = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            known = self.steps[place] == step
            at, state = at[known], self.next[place[known]]
            whole = self.piece[state] >= 0
            if not depth:
                unknown[at[whole]] = False
            found.append((at[whole], np.full(whole.sum(), depth + 1), self.piece[state[whole]]))
            if not len(at):
                break
        lone = np.flatnonzero(unknown)
        found.append((lone, np.ones(len(lone), dtype=np.int64), np.full(len(lone), self.size - 1)))
        at, length, piece = (np.concatenate(column) for column in zip(*found))
        end = start[at] + length
        order = np.argsort(end, kind="stable")
        return word[at][order], start[at][order], end[order], piece[order]


def forward(words: list[str], arcs, weights: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: the sum over all segmentations up to a place."""
    w, start, end, piece = arcs
    alpha = np.zeros((len(words), max(map(len, words)) + 2, weights.shape[1]))
    alpha[:, 0] = 1
    bounds = np.searchsorted(end, np.arange(1, alpha.shape[1] + 1))
    for place in range(1, alpha.shape[1]):
        part = slice(bounds[place - 1], bounds[place])
        if part.start < part.stop:
            np.add.at(alpha, (w[part], place), alpha[w[part], start[part]] * weights[piece[part]])
    return alpha


def expected(words: list[str], counts: np.ndarray, lattice: Lattice, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language from its words and their counts."""
    arcs = lattice.arcs(words)
    w, start, end, piece = arcs
    alpha = forward(words, arcs, weights)[:, :, 0]
    sizes = np.array([len(x) + 1 for x in words])
    beta = np.zeros_like(alpha)
    beta[np.arange(len(words)), sizes] = 1
    bounds = np.searchsorted(end, np.arange(1, alpha.shape[1] + 1))
    for place in range(alpha.shape[1] - 1, 0, -1):
        part = slice(bounds[place - 1], bounds[place])
        if part.start < part.stop:
            np.add.at(beta, (w[part], start[part]), beta[w[part], place] * weights[piece[part], 0])
    total = alpha[np.arange(len(words)), sizes]
    share = alpha[w, start] * weights[piece, 0] * beta[w, end] / np.maximum(total[w], 1e-300)
    return np.bincount(piece, share * counts[w], minlength=lattice.size)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, path: str) -> None:
        self.languages, self.weights, self.path = languages, weights, path


@functools.lru_cache(maxsize=2)
def lattice_of(path: str) -> Lattice:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return Lattice([p for p in pieces if p == START or LETTERS.fullmatch(p.removeprefix(START))])


def fit(
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    max_docs_per_language: int = MAX_DOCS_PER_LANGUAGE,
    path: str | None = None,
) -> Model:
    """Fit on about ``max_docs_per_language`` whole texts of each language, those
    with the smallest hashes of their key and text."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = labelled.where(F.col(label).isNotNull()).select(
        F.col(label).alias("_lang"), code(F.col(text)).alias("_text"), F.pmod(F.xxhash64(key, text), F.lit(1 << 30)).alias("_hash")
    )
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, 0)), path)
    bound = F.lit(0)
    for language, n in sizes.items():
        bound = F.when(F.col("_lang") == language, F.lit(min(1.0, max_docs_per_language / n) * (1 << 30))).otherwise(bound)
    words = rows.where(F.col("_hash") < bound).select("_lang", F.explode(F.expr(r"regexp_extract_all(lower(_text), '\\p{L}+', 0)")).alias("_word"))
    counted: dict[str, list] = {language: [] for language in languages}
    for row in words.groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        if LETTERS.fullmatch(row["_word"]):  # a long word is learned in parts
            parts = [row["_word"][i : i + LONG_WORD] for i in range(0, len(row["_word"]), LONG_WORD)]
            counted[row["_lang"]] += [(part, row["n"]) for part in parts]
    lattice = lattice_of(path)
    columns = []
    for language in languages:
        weights = np.full((lattice.size, 1), 1 / lattice.size)
        seen = sorted(counted[language])
        for _ in range(ROUNDS if seen else 0):
            total = np.zeros(lattice.size)
            for i in range(0, len(seen), 20_000):
                part = seen[i : i + 20_000]
                total += expected([w for w, _ in part], np.array([n for _, n in part], dtype=float), lattice, weights)
            total += SMOOTHING
            weights = (total / total.sum())[:, None]
        weights[-1] = UNKNOWN
        columns.append(weights)
    return Model(languages, np.concatenate(columns, axis=1), path)


class Scorer:
    """Keeps the log-probabilities of words met before, up to a fixed number."""

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, lattice_of(model.path)
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((MAX_WORDS + 1, len(model.languages)))

    def long_word(self, word: str) -> np.ndarray:
        """The same sums with a running scale, window by window, so that the
        memory does not grow with the word."""
        text, reach = START + word, self.lattice.longest
        scale = np.zeros(len(self.model.languages))
        alpha = np.ones((1, len(scale)))  # of the places before the window, at most `reach`
        for base in range(0, len(text), WINDOW):
            before, stop = len(alpha) - 1, min(base + WINDOW, len(text))
            _, start, end, piece = self.lattice.arcs_in([text[base - before : stop]])
            places = stop - base + before + 1
            alpha = np.concatenate([alpha, np.zeros((places - len(alpha), len(scale)))])
            bounds = np.searchsorted(end, np.arange(1, places + 1))
            for place in range(before + 1, places):
                part = slice(bounds[place - 1], bounds[place])
                alpha[place] = (alpha[start[part]] * self.model.weights[piece[part]]).sum(axis=0)
                low = alpha[place] < 1e-100
                if low.any():
                    alpha[max(0, place - reach) : place + 1, low] *= 1e100
                    scale[low] -= np.log(1e100)
            last = alpha[-1]
            alpha = alpha[-(reach + 1) :]
        return np.log(np.maximum(last, 1e-300)) + scale

    def learn(self, words: list[str]) -> None:
        arcs = self.lattice.arcs(words)
        alpha = forward(words, arcs, self.model.weights)
        total = alpha[np.arange(len(words)), [len(w) + 1 for w in words]]
        first = len(self.rows)
        self.logs[first : first + len(words)] = np.log(np.maximum(total, 1e-300))
        self.rows.update(zip(words, range(first, first + len(words))))

    def score(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """Language and posterior of each list of words."""
        words = set().union(*texts)
        new = [w for w in words.difference(self.rows) if len(w) <= LONG_WORD]
        if len(self.rows) + len(new) > MAX_WORDS:
            self.rows.clear()
            new = [w for w in words if len(w) <= LONG_WORD]
            if len(new) > MAX_WORDS:  # more than fit at once: half the texts at a time
                half = len(texts) // 2
                return self.score(texts[:half]) + self.score(texts[half:]) if half else [self.pieced(texts[0])]
        if new:
            self.learn(sorted(new))
        return [self.best(self.total(words)) if words else ("und", 0.0) for words in texts]

    def total(self, words: list[str]) -> np.ndarray:
        places = list(map(self.rows.get, words))
        if None not in places:
            return self.logs[places].sum(axis=0)
        total = self.logs[[p for p in places if p is not None]].sum(axis=0)
        for word, place in zip(words, places):
            if place is None:
                total = total + self.long_word(word)
        return total

    def pieced(self, words: list[str]) -> tuple[str, float]:
        """One text with more distinct words than are kept: part by part."""
        total = np.zeros(len(self.model.languages))
        for i in range(0, len(words), MAX_WORDS):
            self.rows.clear()
            part = words[i : i + MAX_WORDS]
            self.learn(sorted({w for w in part if len(w) <= LONG_WORD}) or ["a"])
            total += self.total(part)
        return self.best(total)

    def best(self, total: np.ndarray) -> tuple[str, float]:
        at = int(np.argmax(total))
        return self.model.languages[at], float(1 / np.exp(total - total[at]).sum())


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Key, the columns to ``carry``, ``lang_pred`` and ``score`` (the posterior of
    that language under equal priors).  Rows are independent: no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.path))
    learned = bool(model.languages)

    def predicted(rows):
        scorer = _scorer(shared)
        held, texts, size = [], [], 0
        for row in rows:
            held.append(row[:-1])
            words = LETTERS.findall(row[-1].lower()) if learned else []
            texts.append(words if any(c.isalpha() for word in words for c in word) else [])
            size += len(row[-1])
            if size >= BATCH_CHARS:
                yield from ((*h, *s) for h, s in zip(held, scorer.score(texts)))
                held, texts, size = [], [], 0
        yield from ((*h, *s) for h, s in zip(held, scorer.score(texts)))

    columns = [key, *carry]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    source = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], code(F.col(text)).alias("_text"))
    return map_rows(source, source.columns, predicted, f"{schema}, lang_pred string, score double")


_SCORERS: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    """One scorer per model and Python worker; a broadcast value is read once per
    worker, so the same model is the same object there."""
    weights = shared.value[1]
    if id(weights) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(weights)] = Scorer(Model(*shared.value))
    return _SCORERS[id(weights)]


def held_out(key: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
