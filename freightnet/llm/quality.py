"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight per hashed feature of the text; ordered thresholds cut the scale into grades:
P(grade <= k) = sigmoid(threshold_k - weights . features). From them come the expected grade and the probability of a
grade or better, by which texts are selected.

Features are the hashed words between white space, and the shape of each word (classes of its first and last character,
its length, and whether it repeats the word before it); both groups as damped counts of unit length. The model is fitted in numpy on a bounded sample of rated
texts; every text is scored whole, where it is, without a shuffle.

Defined cases: NULL and empty texts have no features and get the scores of the thresholds alone; NULL grades and ids are
not learnt from; of several grades of an id the least counts; with one grade only, that grade is certain for all, and
without any rated document that exists the top one is; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.llm.texts import (
    TRAINING_SLICE,
    WORD_BY_SPACE,
    Slice,
    as_arrow,
    byte_set,
    fitted_in_a_task,
    labelled_sample,
    slices,
    small_batches,
)

WORD_BITS, SHAPES = 14, 2 * 8 * 8 * 16
WIDTH = (1 << WORD_BITS) + SHAPES
#: The training sample: most rated texts of one grade. Texts of more than MOST_CHARS characters fill up what is missing,
#: whole ones while those of a grade have LONG_CHARS at most; the first of them is cut there.
MOST_RATED, MOST_CHARS, LONG_CHARS = 1500, 20_000, 6_000_000
ROUNDS, RATE, DECAY = 300, 0.05, 1e-4
_CLASS = np.full(256, 7, np.int64)
for _k, _members in enumerate(
    (range(97, 123), range(65, 91), range(48, 58), range(128, 256), b".,;:", b"!?", b"#*$%&|<>")
):
    _CLASS[byte_set(list(_members))] = _k


def features(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a slice."""
    first, last, bounds = part.words(WORD_BY_SPACE)
    text = np.repeat(np.arange(len(part.rows)), np.diff(bounds))
    word = (part.hashes(first, last) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    ends = _CLASS[part.data[first]] * 8 + _CLASS[part.data[last - 1]]
    again = np.append(False, (word[1:] == word[:-1]) & (text[1:] == text[:-1]))[: len(word)]
    shape = (1 << WORD_BITS) + (again * 64 + ends) * 16 + np.minimum(last - first, 15)
    found = []
    for feature in (word, shape):
        key, count = np.unique(text * WIDTH + feature, return_counts=True)
        value = np.log1p(count)
        at = key // WIDTH
        norm = np.sqrt(np.bincount(at, value * value, len(part.rows)))
        found.append((at, key % WIDTH, value / norm[at]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class CumulativeLink:
    """Weights by feature and ordered thresholds, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, part: Slice) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one row per text."""
        at, feature, value = features(part)
        level = np.bincount(at, self.weights[feature] * value, len(part.rows))
        return _sigmoid(level[:, None] - self.thresholds[None, :])


def train(texts: Sequence[str], grades: Sequence[int], n_grades: int) -> CumulativeLink:
    """Fit by Adam on the full sample; rare grades count more. Thresholds are kept in order by positive steps."""
    y = np.array(grades, np.int64)
    if len(np.unique(y)) < 2:
        only = int(y[0]) if len(y) else n_grades - 1
        return CumulativeLink(np.zeros(WIDTH), np.where(np.arange(1, n_grades) <= only, -50.0, 50.0))
    found = [(part.rows, *features(part)) for part in slices(pa.array(texts, pa.large_string()), TRAINING_SLICE)]
    at, feature, value = (np.concatenate(x) for x in zip(*[(rows[a], f, x) for rows, a, f, x in found]))
    count = np.bincount(y, minlength=n_grades)
    weight = (np.maximum(count, 1) ** -0.5)[y]
    weight /= weight.sum()
    w, steps = np.zeros(WIDTH), np.append(-0.5, np.zeros(n_grades - 2))
    moments = [np.zeros_like(x) for x in (w, w, steps, steps)]
    for t in range(1, ROUNDS + 1):
        thresholds = np.cumsum(np.append(steps[:1], np.exp(steps[1:])))
        level = np.bincount(at, w[feature] * value, len(y))
        below = np.concatenate([np.zeros((len(y), 1)), _sigmoid(thresholds - level[:, None]), np.ones((len(y), 1))], axis=1)
        rows = np.arange(len(y))
        high, low = below[rows, y + 1], below[rows, y]
        chance = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / chance * weight, low * (1 - low) / chance * weight
        d_level = slope_high - slope_low  # of the loss by the level
        d_threshold = np.bincount(y, -slope_high, n_grades)[:-1] + np.bincount(y, slope_low, n_grades)[1:]
        d_w = np.bincount(feature, d_level[at] * value, WIDTH) + DECAY * w
        tail = np.cumsum(d_threshold[::-1])[::-1]
        d_steps = np.append(tail[:1], tail[1:] * np.exp(steps[1:]))
        rate = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for x, d, m, v in ((w, d_w, moments[0], moments[1]), (steps, d_steps, moments[2], moments[3])):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            x -= rate * m / (np.sqrt(v) + 1e-8)
    return CumulativeLink(w, np.cumsum(np.append(steps[:1], np.exp(steps[1:]))))


def training_sample(documents: DataFrame, ratings: DataFrame, n_grades: int, id_col: str) -> DataFrame:
    """(h, text, label): at most MOST_RATED texts of each grade by the hash of their id, those of at most MOST_CHARS characters first; long
    ones only where there are too few others."""
    usable = ratings.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(id_col)
    usable = usable.agg(F.min("grade").alias("label"))
    most = {grade: MOST_RATED for grade in range(n_grades)}
    return labelled_sample(documents, usable, most, MOST_CHARS, LONG_CHARS, id_col)


def grade_documents(
    documents: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id"
) -> DataFrame:
    """One row per document: id, expected_grade, at_least (array: P(grade >= 1), P(grade >= 2), ...).

    ``ratings`` has (id, grade) with grades from 0 to n_grades - 1.
    """
    spark = documents.sparkSession
    small_batches(spark)
    sample = training_sample(documents, ratings, n_grades, id_col)
    model = spark.sparkContext.broadcast(fitted_in_a_task(sample, lambda texts, grades: train(texts, grades, n_grades)))
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(id_col, F.col("text").cast("string").alias("text"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        tail = np.zeros((batch.num_rows, n_grades - 1))
        for part in slices(batch.column("text")):
            tail[part.rows] = model.value.at_least(part)
        columns = [batch.column(id_col), pa.array(tail.sum(axis=1)), pa.array(list(tail), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "expected_grade", "at_least"])

    return as_arrow(rows, score, f"{id_col} {kind}, expected_grade double, at_least array<double>")
