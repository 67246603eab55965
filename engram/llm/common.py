"""Shared plumbing: the shared folder, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, one is made on a single machine; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="engram-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_collecting: ContextVar[list[str] | None] = ContextVar("collecting", default=None)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The tables that the block writes, so that its caller can remove them, and only them, when done."""
    made: list[str] = []
    token = _collecting.set(made)
    try:
        yield made
    finally:
        _collecting.reset(token)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    if (made := _collecting.get()) is not None:
        made.append(path)
    out = spark.read.schema(schema).parquet(path)
    out._written = path  # for discard()
    return out


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_written", None):
            remove(t.sparkSession, path)


SIEVE_BITS, SIEVE_HASHES = 1 << 26, 3


def sieve(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of ``key`` long, of ``SIEVE_BITS`` bits whatever the number of keys: 64-bit words by partial aggregates."""
    bit = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), "key"), F.lit(SIEVE_BITS)) for k in range(SIEVE_HASHES)]))
    words = keys.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    got = words.toArrow()  # SIEVE_BITS / 64 rows at most
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def sifted(df: DataFrame, key: Column, keys: DataFrame) -> Callable[..., DataFrame]:
    """A choice of ``df``'s rows: of True, those whose key may be among ``keys`` (key long); of False, those whose key is not.

    The first are for a join that decides; the others need none, so that their texts are not shuffled. With so
    many keys that most bits are set, all rows are among the first: more work, the same results. What is to
    be done ``then`` with the chosen rows' batches can go in the same Python worker, with its schema."""
    shared = df.sparkSession.sparkContext.broadcast(sieve(keys))  # SIEVE_BITS: a fixed size
    places = [F.pmod(F.xxhash64(F.lit(k), key), F.lit(SIEVE_BITS)).alias(f"place{k}") for k in range(SIEVE_HASHES)]
    placed, columns, width = df.select("*", *places), df.columns, len(df.columns)

    def choose(wanted: bool, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter, schema=None) -> DataFrame:
        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for b in batches:
                passed = np.ones(b.num_rows, bool)
                for c in b.columns[width:]:
                    place = c.to_numpy()
                    passed &= (bits[place >> 6] >> (place & 63)) & 1 == 1
                rows = pa.array(passed == wanted)
                yield pa.RecordBatch.from_arrays([c.filter(rows) for c in b.columns[:width]], names=columns)

        return placed.mapInArrow(lambda batches: then(chosen(batches)), df.schema if schema is None else schema)

    return choose


#: What tasks of one kind keep in their Python worker for the next ones.
kept_for_tasks: dict = {}


def let_go() -> None:
    """At the start of a task that needs memory of its own: what tasks of other kinds have left in this worker goes."""
    if kept_for_tasks:
        kept_for_tasks.clear()
        gc.collect()


def documents_of(df: DataFrame) -> DataFrame:
    """The two columns that the text operators use; any others, whatever their names, are left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole column and its row offsets; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def write_bytes(uri: str, chunks: Iterator[bytes]) -> int:
    """Write a file in the shared store as a whole or not at all: a lost or repeated task leaves no torn file."""
    size, temp = 0, f"{uri}.{uuid.uuid4().hex}.tmp"
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(local_path(temp), "wb") as out:
            for x in chunks:
                size += out.write(x)
        os.replace(local_path(temp), path)
        return size
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(temp)
    with store.open_output_stream(at) as out:
        for x in chunks:
            out.write(x)
            size += len(x)
    store.move(at, fs.FileSystem.from_uri(uri)[1])
    return size


def open_bytes(uri: str):
    """A seekable binary file in the shared store."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    return store.open_input_file(at)
