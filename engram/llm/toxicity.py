"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

N-grams are the runs of 3 to 8 characters of a text within a word and the blanks around it, lower-cased for
A-Z, with white space made one kind and each side of the text a blank; they are hashed to 2^bits places. An
n-gram counts once for a text. Its log-count ratio r = log((p + a) / |p|) - log((q + a) / |q|) compares the
labelled positive and negative texts that hold it; a logistic regression is learned over the features'
presence times r, and an n-gram whose presence says little (|r| under ``least``, or fewer than ``support``
texts) has no weight, so that long clean texts gather no noise. Training takes a bounded sample of labelled
rows (``sample``), a documented parameter; n-grams are found and counted in tasks, and only those with a
ratio come to the driver. Whole texts are scored.

Defined cases: a null text is an empty one; an empty text gets the bias alone; null identifiers are
scored, with a null ``held_out``; repeated rows are scored each for itself; no labelled rows, or labels
of one kind, give the constant (positives + 1) / (rows + 2); an empty table gives an empty result;
columns other than doc_id and text are never read.
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
from .textvec import LOWER, SPACED, _MULT, mixed

SIZES = (3, 4, 5, 6, 7, 8)
GROUP_BYTES = 1 << 19


@dataclass
class RatioModel:
    """Weight by hashed n-gram: the regression's weight times the log-count ratio."""

    weights: np.ndarray
    bias: float
    bits: int
    constant: float | None = None

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        total = np.zeros(n)
        for at, feature in hashed(data, offsets, self.bits):
            heavy = np.flatnonzero(self.weights[feature])  # few n-grams have weight, so distinct ones are cheap to find
            key = np.unique((at[heavy] << self.bits) | feature[heavy])
            total += np.bincount(key >> self.bits, weights=self.weights[key & ((1 << self.bits) - 1)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each character of UTF-8 texts: lower-cased, blanks in a row as one, one before and one after each text."""
    n = len(offsets) - 1
    plain = LOWER[data]
    plain[SPACED[data] == 0] = 32
    first = np.flatnonzero((plain & 0xC0) != 0x80)  # where characters begin
    value = plain[first].astype(np.uint64)
    width = np.diff(np.append(first, len(plain)))
    for k in (1, 2, 3):
        more = width > k
        value[more] = value[more] << np.uint64(8) | plain[first[more] + k]
    row = np.searchsorted(offsets, first, "right") - 1
    at = np.searchsorted(row, np.arange(n))
    end = np.searchsorted(row, np.arange(n), "right")
    # A blank goes after each text's last character and before its first, in this order where two texts meet.
    value = np.insert(value, np.concatenate([end, at]), 32)
    row = np.insert(row, np.concatenate([end, at]), np.tile(np.arange(n), 2))
    kept = np.ones(len(value), bool)
    kept[1:] = (value[1:] != 32) | (value[:-1] != 32) | (row[1:] != row[:-1])
    return row[kept], value[kept]


def hashed(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram: the row and the hashed place of every one that has no blank but at its ends."""
    row, value = characters(data, offsets)
    blank = np.concatenate([[0], np.cumsum(value == 32)])
    value, run = mixed(value + np.uint64(1)), np.zeros(len(value), np.uint64)
    for k in range(1, SIZES[-1] + 1):
        m = len(value) - k + 1
        if m <= 0:
            return
        with np.errstate(over="ignore"):
            run = run[:m] * _MULT + value[k - 1 :]
        if k in SIZES:
            whole = (row[:m] == row[k - 1 :]) & (blank[k - 1 : k - 1 + m] == blank[1 : m + 1])
            with np.errstate(over="ignore"):
                place = mixed(run[whole] + np.uint64(k)) >> np.uint64(64 - bits)
            yield row[:m][whole], place.astype(np.int64)


def present(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each text's distinct n-grams, ascending."""
    found = [(at << bits) | place for at, place in hashed(data, offsets, bits)]
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key >> bits, key & ((1 << bits) - 1)


def ratios(p: np.ndarray, q: np.ndarray, positive: int, negative: int, smooth: float) -> np.ndarray:
    """Log-count ratios of n-grams in p of the positive and q of the negative texts."""
    return np.log((p + smooth) / (positive + 2 * smooth)) - np.log((q + smooth) / (negative + 2 * smooth))


def train(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray, rate: float = 0.3, l2: float = 1e-4, epochs: int = 8) -> tuple[np.ndarray, float]:
    """(weights, bias): Adagrad logistic regression over the features' ratios, in the order given, ``epochs`` times."""
    w, g2, bias, bias2 = np.zeros(len(ratio)), np.full(len(ratio), 1e-8), 0.0, 1e-8
    for _ in range(epochs):
        for y, f in rows:
            x = ratio[f]
            error = 1 / (1 + np.exp(-np.clip(w[f] @ x + bias, -35, 35))) - y
            g = error * x + l2 * w[f]
            g2[f] += g * g
            w[f] -= rate * g / np.sqrt(g2[f] + 1)
            bias2 += error * error
            bias -= rate * error / np.sqrt(bias2 + 1)
    return w, float(bias)


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample: int = 3000, bits: int = 21, folds: int = 4, held_out: int = 2, smooth: float = 0.5, least: float = 2.5, support: int = 4, places: int = 1 << 24) -> RatioModel:
    """Learn from at most ``sample`` labelled rows outside the held-out fold.

    All of them give the ratios. The weights are learnt from the first of them, by identifier hash, that have ``places`` telling
    n-grams together at most: the bound of the driver's memory, reached by rows of over ``places / sample`` such n-grams each (5,592)."""
    chosen = training_sample(documents, labels, "toxic", folds, held_out, sample, lambda data, offsets: present(data, offsets, bits))
    kinds = chosen.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("positive"), F.count("*").alias("n")).first()
    positive, n = kinds.positive, kinds.n
    if positive in (0, n):
        return RatioModel(np.zeros(0), 0.0, bits, (positive + 1) / (n + 2))
    counts = chosen.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.count("*").alias("pq")).where(F.col("pq") >= support)
    got = counts.select("f", "p", (F.col("pq") - F.col("p")).alias("q")).toArrow()  # 2^bits rows at most
    f, p, q = (got.column(x).to_numpy() for x in ("f", "p", "q"))
    r = ratios(p, q, positive, n - positive, smooth)
    ratio = np.zeros(1 << bits)
    ratio[f[np.abs(r) >= least]] = r[np.abs(r) >= least]
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(ratio != 0))  # 2^bits bits: a fixed size

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            lists = [x[marks[x]] for x in (v.values.to_numpy(zero_copy_only=False) for v in b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(lists, pa.list_(pa.int32()))], b.schema.names)

    rows = within(chosen.mapInArrow(telling, chosen.schema), sample, places)
    discard(chosen)
    w, bias = train(rows, ratio)
    return RatioModel((w * ratio).astype(np.float32), bias, bits)


def score_toxicity(documents: DataFrame, model: RatioModel) -> DataFrame:
    """(doc_id, score) of every row, over whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2^bits weights: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(1))
            score = [shared.value.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in groups(offsets, GROUP_BYTES)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score) if score else np.zeros(0))], ["doc_id", "score"])

    return documents_of(documents).mapInArrow(run, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = 3000, threshold: float = 0.3, folds: int = 4, held_out: int = 2, places: int = 1 << 24) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; ``sample`` and ``places`` bound what the classifier learns from."""
    model = fit_toxicity(documents, labels, sample, folds=folds, held_out=held_out, places=places)
    return score_toxicity(documents, model).select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
