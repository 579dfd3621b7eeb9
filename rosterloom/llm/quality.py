"""Quality by ordinal regression on graded ratings (operator 6).

Grades: 0 toxic, 1 poor, 2 good.  One weight vector over hashed text features
gives a latent score; ordered thresholds cut it into grades, with cumulative
logits P(grade <= k) = 1 / (1 + exp(score - threshold k)).  Features are the
lower-cased words, their first letters, the shapes of words by their share, the
share of repeated words and lines, and the length, each present or not, so that
one telling word counts the same in a text of any length.  First letters stand
for the forms of an inflected or compounded word, each of which is too rare to
get a weight; two forms with the same ones are a feature of their own.

The model is fitted on a bounded sample of labelled rows; features seen in fewer
than ``MIN_DOCS`` of its texts get no weight.  Labels that are null or belong to
no document do not take part.  A null text is empty.  Without any label, every
text has the same score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import Recent, code, map_rows
from rosterloom.session import ship_package

GRADES = 3
MAX_LABELLED = 8_000
MIN_DOCS = 6
MIN_Z = 3.5
ROUNDS = 200
PENALTY = 5e-4
MIN_TAIL = 0.5
MAX_WORDS = 40_000
EDGES = re.compile(r"^\W+|\W+$")
STEMS = (5, 6, 7)
TWICE = 0x9E3779B9
LEVELS = (0.01, 0.04, 0.1, 0.2, 0.4, 0.7)


def bucket(name: str) -> int:
    """Feature number of a name, one of 2**32."""
    return zlib.crc32(name.encode())


def parts(word: str) -> tuple[int, str, tuple[int, ...]]:
    """The hashed core of a word, its shape and its hashed first letters, as many
    as in ``STEMS``.  Shapes: all capitals, other letters, digits, single marks as
    they are, and ``~`` for a run of marks."""
    if word.isalpha():
        core, shape = word.lower(), "A" if len(word) > 1 and word.isupper() else "a"
    else:
        core = EDGES.sub("", word).lower()
        letters = ("A" if len(core) > 1 and word.isupper() else "a") if core.isalpha() else ""
        marks = EDGES.findall(word) if core else [word]
        shape = letters + "".join("~" if len(m) > 1 else m for m in marks if m)
    return bucket("word " + core), shape, tuple([bucket("stem " + core[:n]) for n in STEMS if len(core) > n])


PARTS = Recent(parts, MAX_WORDS)


def levels(name: str, share: float) -> list[int]:
    """A share as features: one for each level that it reaches."""
    return [bucket(f"{name} {level}") for level in LEVELS if share >= level] if share >= LEVELS[0] else []


def features(text: str) -> set[int]:
    words = Counter(text.split())
    total = max(1, sum(words.values()))
    found, twice, shapes = set(), set(), Counter()
    for word, n in words.items():
        core, shape, stems = PARTS[word]
        if core not in found:
            found.add(core)
            for stem in stems:
                (twice if stem in found else found).add(stem)
        shapes[shape] += n
    found.update([stem ^ TWICE for stem in twice])
    for shape, n in shapes.items():
        found.update(levels("shape " + shape, n / total))
    lines = [line for line in text.split("\n") if line.strip()]
    found.update(levels("repeated words", 1 - len(words) / total))
    found.update(levels("repeated lines", 1 - len(set(lines)) / max(1, len(lines))))
    found.add(bucket(f"length {total.bit_length()}"))
    return found


class Model(NamedTuple):
    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def score(self, text: str) -> float:
        weight = self.weights.get
        return sum([weight(f, 0.0) for f in features(text)], 0.0)


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def sample_labels(labels: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` graded rows, those with the smallest hashes of the key."""
    graded = labels.select(F.col(key).alias("_key"), grade(F.col("quality"), F.col("toxic")).alias("_grade"))
    graded = graded.where("_key IS NOT NULL AND _grade IS NOT NULL").dropDuplicates(["_key"])
    share = min(1.0, most / max(1, graded.count()))
    return graded.where(F.pmod(F.xxhash64(F.col("_key")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def fit(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED
) -> Model:
    """Fit on about ``max_labelled`` labelled texts.  The sampled labels have that
    bound and are therefore broadcast; only hashed features reach the driver."""
    chosen = F.broadcast(sample_labels(labels, key, max_labelled))
    texts = df.select(F.col(key).alias("_key"), code(F.col(text)).alias("_text")).join(chosen, "_key")

    def hashed(rows):
        for g, value in rows:
            yield g, np.array(sorted(features(value)), dtype="<u4").tobytes()

    rows = map_rows(texts, ["_grade", "_text"], hashed, "grade int, features binary").collect()
    rows.sort(key=lambda r: (r["grade"], bytes(r["features"])))
    return regress([np.frombuffer(r["features"], dtype="<u4") for r in rows], np.array([r["grade"] for r in rows], dtype=int))


def grade_slopes(score: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the negative log-likelihood in each score and each threshold."""
    rows = np.arange(len(grades))
    below = np.zeros((len(grades), GRADES + 1))
    below[:, -1] = 1
    below[:, 1:-1] = 1 / (1 + np.exp(np.clip(score[:, None] - thresholds, -500, 500)))
    upper, lower = below[rows, grades + 1], below[rows, grades]
    chance = np.maximum(upper - lower, 1e-9)[:, None]
    density = below[:, 1:-1] * (1 - below[:, 1:-1])
    cut = np.arange(GRADES - 1)
    rise = (density / chance * ((grades[:, None] == cut + 1) * 1.0 - (grades[:, None] == cut))).sum(axis=0)
    return 1 - upper - lower, rise


def regress(sets: list[np.ndarray], grades: np.ndarray) -> Model:
    """Maximum likelihood of the cumulative logits, by full-batch Adagrad.

    Before that, features pass a score test: without any weights, the mean slope
    of the texts that have a feature must be ``MIN_Z`` standard errors from 0.
    Words that are in few texts would only fit the sample's noise."""
    if not len(grades):
        return Model({}, tuple(range(GRADES - 1)))
    names, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n = len(grades)
    share = (np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] + 1) / (n + 2)
    thresholds = np.log(share / (1 - share))
    pull, _ = grade_slopes(np.zeros(n), thresholds, grades)
    pull = pull - pull.mean()
    test = np.bincount(column, pull[row]) / np.sqrt(np.maximum(np.bincount(column, pull[row] ** 2), 1e-12))
    chosen = np.flatnonzero((seen >= MIN_DOCS) & (np.abs(test) >= MIN_Z))
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[column] >= 0
    row, column, names = row[kept], place[column][kept], names[chosen]

    weights, squares, cut_squares = np.zeros(len(names)), np.full(len(names), 1e-8), np.full(GRADES - 1, 1e-8)
    for _ in range(ROUNDS):
        pull, rise = grade_slopes(np.bincount(row, weights[column], minlength=n), thresholds, grades)
        slope = np.bincount(column, pull[row], minlength=len(names)) / n + PENALTY * weights
        squares += slope**2
        weights -= 0.5 * slope / np.sqrt(squares)
        cut_squares += (rise / n) ** 2
        thresholds = np.sort(thresholds - 0.2 * rise / n / np.sqrt(cut_squares))
    return Model(dict(zip(names.tolist(), weights.tolist())), tuple(thresholds.tolist()))


def rate(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``expected_grade`` and ``p_good``, the chance of the highest grade.
    Rows are independent: no shuffle."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tuple(model))
    cuts = model.thresholds

    @F.pandas_udf("double")
    def latent(texts: pd.Series) -> pd.Series:
        scorer = Model(*shared.value)
        return texts.map(scorer.score).astype("float64")

    above = [1 - 1 / (1 + F.exp(F.col("_score") - F.lit(cut))) for cut in cuts]
    rated = df.withColumn("_score", latent(code(F.col(text))))
    return rated.select(*df.columns, sum(above, F.lit(0.0)).alias("expected_grade"), above[-1].alias("p_good"))


def selected(min_tail: float = MIN_TAIL) -> Column:
    return F.col("p_good") >= F.lit(min_tail)
