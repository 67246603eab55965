"""Labelled samples for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, let_go, strings, written

GROUP_BYTES = 1 << 19


def fold(doc_id, folds: int):
    """crc32 of the identifier as text, modulo ``folds``; null for a null identifier."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % F.lit(folds)


def training_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, places: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(o, k, y, features array<int>), written: hashed features of at most ``most`` labelled rows from outside the held-out fold.

    The sample is the rows of least identifier hash: the same rows whatever the order of the input. Rows with a
    null identifier or label teach nothing. ``places`` gives each text's features, in tasks: (row, place) pairs
    in order of rows. No text comes to the driver."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("k"), F.col(label).cast("int").alias("y"))
        .where("k is not null and y in (0, 1)")
        .where(fold(F.col("k"), folds) != held_out)
        .orderBy(F.xxhash64("k"), "k", "y")
        .limit(most)
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            data, offsets = strings(b.column(2))
            for i, j in groups(offsets, GROUP_BYTES):
                row, place = places(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), lists], ["k", "y", "features"])

    # The sample's bound is `most` rows of two numbers, so it can always be broadcast.
    found = texts.join(F.broadcast(chosen), "k").select("k", "y", "text").mapInArrow(run, "k long, y int, features array<int>")
    return written(found.select(F.xxhash64("k").alias("o"), "k", "y", "features"), "sample")


def within(sample: DataFrame, most: int, places: int) -> list[tuple[int, np.ndarray]]:
    """(label, features) of the sample's first rows: at most ``most``, of at most ``places`` features together, in a fixed order."""
    sized = sample.withColumn("c", F.xxhash64("features")).withColumn("s", F.size("features").cast("long"))
    order = Window.orderBy("o", "k", "y", "c")  # of numbers alone, one row for each of a bounded sample
    last = sized.select("o", "k", "y", "c", F.sum("s").over(order).alias("sum"), F.row_number().over(order).alias("n")).where(f"sum <= {places} and n <= {most}").agg(F.max(F.struct("n", "o", "k", "y", "c")).alias("m")).first().m
    if last is None:
        return []
    got = sized.where(F.struct("o", "k", "y", "c") <= F.struct(*[F.lit(last[x]).cast(sized.schema[x].dataType).alias(x) for x in ("o", "k", "y", "c")])).select("o", "k", "y", "c", "features").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: tuple(got.column(x)[i].as_py() for x in ("o", "k", "y", "c")))
    y, lists = got.column("y"), got.column("features")
    return [(y[i].as_py(), lists[i].values.to_numpy(zero_copy_only=False).astype(np.int64)) for i in order[:most]]
