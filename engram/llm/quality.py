"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's words are runs of letters, of digits or of other marks, lower-cased for A-Z. Features are its
distinct words and neighbouring pairs, hashed to 2^bits places, each with value 1 / sqrt(how many), and
one of value 1 for how many n-grams it has and what share of them is distinct (both in steps).
Training takes a bounded sample of labelled rows (``sample``, and ``places`` features of them together),
documented parameters; features are found in tasks. Scores are sparse dot products over whole texts.

Defined cases: a null text is an empty one; an empty text has no features and gets the bias alone; null
identifiers are scored too, with a null ``held_out``; repeated rows are scored each for itself; no
labelled rows, or labels of one kind, give the constant (positives + 1) / (rows + 2); an empty table
gives an empty result; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents_of, groups, strings
from .labelled import fold, training_sample, within
from .textvec import KINDS, mixed, word_hashes

GROUP_BYTES = 1 << 20


@dataclass
class FtrlModel:
    """Weights by hashed feature; ``constant`` stands for all where nothing could be learned."""

    weights: np.ndarray
    bias: float
    bits: int
    constant: float | None = None

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        at, feature, shape = features(data, offsets, self.bits)
        n = len(offsets) - 1
        count = np.bincount(at, minlength=n)
        total = np.bincount(at, weights=self.weights[feature], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(count, 1)) + self.weights[shape] + self.bias, -35, 35)))


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, and the place of each row's length and distinct share."""
    words, parts = word_hashes(data, offsets, KINDS)
    n = len(offsets) - 1
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), shape_of(np.zeros(n, np.int64), np.zeros(n, np.int64), bits)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(parts))
    with np.errstate(over="ignore"):
        pair = mixed(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:])
    same = row[1:] == row[:-1]
    hashed = np.concatenate([words, pair[same]]) & np.uint64((1 << bits) - 1)
    key = np.unique((np.concatenate([row, row[1:][same]]).astype(np.uint64) << np.uint64(bits)) | hashed)
    at = (key >> np.uint64(bits)).astype(np.int64)
    count = np.diff(parts)
    return at, (key & np.uint64((1 << bits) - 1)).astype(np.int64), shape_of(np.bincount(at, minlength=n), np.maximum(2 * count - 1, 0), bits)


def shape_of(distinct: np.ndarray, total: np.ndarray, bits: int) -> np.ndarray:
    share = (8 * distinct) // np.maximum(total, 1)
    size = np.floor(np.log2(np.maximum(total, 1))).astype(np.int64) // 2
    return (mixed((share * 64 + size + 1).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def places_of(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each text's features, its length and distinct share last."""
    at, feature, shape = features(data, offsets, bits)
    row = np.concatenate([at, np.arange(len(shape))])
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate([feature, shape])[order]


def train(rows: list[tuple[int, np.ndarray]], bits: int = 20, alpha: float = 4.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> FtrlModel:
    """FTRL-proximal with a rate for each coordinate, over the rows (label, places) in the order given, ``epochs`` times."""
    positive = sum(y for y, _ in rows)
    if positive in (0, len(rows)):
        return FtrlModel(np.zeros(0, np.float32), 0.0, bits, (positive + 1) / (len(rows) + 2))
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    seen = []
    for y, f in rows:
        value = np.full(len(f) + 1, 1 / np.sqrt(max(len(f) - 1, 1)))
        value[-2:] = 1
        seen.append((np.append(f, size), value, y))

    def weight(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        w = -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2)
        w[np.abs(zf) <= l1] = 0
        return w

    for _ in range(epochs):
        for f, value, y in seen:
            w = weight(f)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
    w = weight(np.arange(size + 1))
    return FtrlModel(w[:-1].astype(np.float32), float(w[-1]), bits)


def fit_quality(documents: DataFrame, labels: DataFrame, sample: int = 6000, places: int = 1 << 25, bits: int = 20, folds: int = 3, held_out: int = 1) -> FtrlModel:
    """Learn from at most ``sample`` labelled rows outside the held-out fold, of at most ``places`` features."""
    chosen = training_sample(documents, labels, "quality", folds, held_out, sample, lambda data, offsets: places_of(data, offsets, bits))
    rows = within(chosen, sample, places)
    discard(chosen)
    return train(rows, bits)


def score_quality(documents: DataFrame, model: FtrlModel) -> DataFrame:
    """(doc_id, score) of every row, over whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2^bits weights: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(1))
            score = [shared.value.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in groups(offsets, GROUP_BYTES)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score) if score else np.zeros(0))], ["doc_id", "score"])

    return documents_of(documents).mapInArrow(run, "doc_id long, score double")


def quality(documents: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.5, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit_quality(documents, labels, sample, folds=folds, held_out=held_out)
    return score_quality(documents, model).select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(documents: DataFrame, model: FtrlModel, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that the model does not reject; each row by itself, without a join."""
    shared, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(at))
            for i, j in groups(offsets, GROUP_BYTES):
                score = shared.value.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield b.slice(i, j - i).filter(pa.array(score >= threshold))

    return documents.mapInArrow(run, documents.schema)
