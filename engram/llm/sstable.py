"""Token-ID output as sorted-string-table shards.

A shard file holds documents in ascending key order:

    data blocks | sparse index | Bloom filter | footer

- Key: the identifier as 8 big-endian bytes with the sign bit turned (so bytes sort as numbers; a null
  identifier is the empty key and sorts first), then 4 bytes that count repeats of the identifier.
- Data block: entries (shared key length, rest length, value length as varints; rest of key; value), each
  key without the prefix it shares with the one before; compressed by zstandard as a whole, followed by a
  crc32 of the stored bytes. A block closes at ``BLOCK_BYTES``; a longer document is a block of its own.
- Value: token ids, little-endian, 2 bytes each where the whole vocabulary fits, else 4.
- Sparse index: for each block its first key, place and length. Bloom filter: double hashing over keys.
- Footer, fixed size: places and lengths of index and filter, entries, ids, id width, crc32, magic.

A lookup asks the filter, searches the index by halves, and reads one block. Shards partition the
identifiers by range, so a manifest of (shard, path, first key, entries, ids) leads to any document.
Files are written under a temporary name and renamed, so a repeated or lost task does no harm.

Defined cases: a null text is an empty one (its value is the end id alone); repeated identifiers are all
kept, in the order of their texts; rows with a null identifier come first; an empty table gives no shard
and an empty result; other columns are never read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LibraryBpe, encoder, in_groups
from .common import documents_of, new_path, open_bytes, write_bytes, written

BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"ENGRSST1"
FOOTER = struct.Struct("<QQQQQQII8s")
MANIFEST = "shard int, path string, first_id long, last_id long, entries long, tokens long, bytes long"


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    return (b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))) + struct.pack(">I", repeat)


def id_of(key: bytes) -> int | None:
    return None if len(key) == 4 else struct.unpack(">Q", key[:8])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) * 2654435761 + 1 | 1
    return [(a * 40503 + i * b) % bits for i in range(BLOOM_HASHES)]


def table_bytes(entries: Iterable[tuple[bytes, bytes]], width: int, told: dict) -> Iterator[bytes]:
    """The file's bytes for entries in key order; ``told`` gets entries, tokens, first and last key."""
    squeeze = zstandard.ZstdCompressor(level=1)
    index: list[tuple[bytes, int, int]] = []
    keys: list[bytes] = []
    place = tokens = 0
    block, size, before, first = [], 0, b"", b""

    def closed() -> bytes:
        nonlocal place
        stored = squeeze.compress(b"".join(block))
        stored += struct.pack("<I", zlib.crc32(stored))
        index.append((first, place, len(stored)))
        place += len(stored)
        return stored

    for key, value in entries:
        if keys and key <= keys[-1]:
            raise ValueError("keys must ascend")
        if block and size + len(value) > BLOCK_BYTES:
            yield closed()
            block, size, before = [], 0, b""
        first = first if block else key
        shared = next((i for i, (x, y) in enumerate(zip(key, before)) if x != y), min(len(key), len(before)))
        block += [varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value]
        size += len(value) + len(key)
        before = key
        keys.append(key)
        tokens += len(value) // width
    if block:
        yield closed()
    packed = b"".join(varint(len(k)) + k + varint(p) + varint(n) for k, p, n in index)
    bits = max(64, len(keys) * BLOOM_BITS)
    bloom = bytearray((bits + 7) // 8)
    for k in keys:
        for x in bloom_places(k, bits):
            bloom[x >> 3] |= 1 << (x & 7)
    yield packed
    yield bytes(bloom)
    told |= {"entries": len(keys), "tokens": tokens, "first": keys[0] if keys else b"", "last": keys[-1] if keys else b""}
    yield FOOTER.pack(place, len(packed), place + len(packed), bits, len(keys), tokens, width, zlib.crc32(packed + bytes(bloom)), MAGIC)


class Reader:
    """A shard file: lookups by key, and all entries in order."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2) if hasattr(file, "fileno") else file.size()
        file.seek(end - FOOTER.size)
        self.index_at, index_len, bloom_at, self.bits, self.entries, self.tokens, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table file")
        file.seek(self.index_at)
        packed, self.bloom = file.read(index_len), file.read((self.bits + 7) // 8)
        if zlib.crc32(packed + self.bloom) != crc:
            raise ValueError("index or filter is damaged")
        self.first, self.places, at = [], [], 0
        while at < len(packed):
            n, at = read_varint(packed, at)
            self.first.append(packed[at : at + n])
            place, at = read_varint(packed, at + n)
            size, at = read_varint(packed, at)
            self.places.append((place, size))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        place, size = self.places[i]
        self.file.seek(place)
        stored = self.file.read(size)
        if struct.unpack("<I", stored[-4:])[0] != zlib.crc32(stored[:-4]):
            raise ValueError("block is damaged")
        data = zstandard.ZstdDecompressor().decompress(stored[:-4])
        at, key = 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        return chain.from_iterable(self.block(i) for i in range(len(self.places)))

    def get(self, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
        key = key_of(doc_id, repeat)
        if not all(self.bloom[x >> 3] >> (x & 7) & 1 for x in bloom_places(key, self.bits)):
            return None
        i = bisect_right(self.first, key) - 1
        found = next((v for k, v in self.block(i) if k == key), None) if i >= 0 else None
        return None if found is None else self.ids(found)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")


def write_tables(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the shards of a documents table; return their manifest."""
    spark = documents.sparkSession
    folder = folder or new_path(spark, "sstable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, LibraryBpe)
        width = 2 if max(len(e.vocabulary.tokens) - 1, end_id) < 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{width}").tobytes()

        def entries() -> Iterator[tuple[bytes, bytes]]:
            last, repeat = object(), 0
            for b in batches:
                keys, at = b.column(0).to_pylist(), 0
                for group in in_groups(b.column(1).cast(pa.binary()).to_pylist()):
                    for doc_id, ids in zip(keys[at : at + len(group)], e.encode(group)):
                        repeat = repeat + 1 if doc_id == last else 0
                        last = doc_id
                        yield key_of(doc_id, repeat), np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end
                    at += len(group)

        rows = entries()
        if (head := next(rows, None)) is None:
            return
        told: dict = {}
        path = f"{folder}/{shard:06d}.sst"
        size = write_bytes(path, table_bytes(chain([head], rows), width, told))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "first_id": id_of(told["first"]), "last_id": id_of(told["last"]), "entries": told["entries"], "tokens": told["tokens"], "bytes": size}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("entries", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    # One shuffle, by range of identifier: text is smaller than its ids. The manifest is written, so files are made once.
    sorted_docs = documents_of(documents).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(sorted_docs.mapInArrow(run, MANIFEST), "sstable-manifest")


def read_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry of the shards, read back from their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                start, out = row["start"], []
                with open_bytes(row["path"]) as f:
                    reader = Reader(f)
                    for key, value in reader:
                        ids = reader.ids(value)
                        out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) >= 50_000:
                            yield batch_of(out)
                            out = []
                if out:
                    yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a shard, so the window's single task is of the number of files, not of documents.
    placed = manifest.select("shard", "path", (F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("start")).select("shard", "path", F.coalesce("start", F.lit(0)).alias("start"))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_tables(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode every whole text, write shards, and return what the files hold."""
    return read_tables(write_tables(documents, tokenizer, end_id))
