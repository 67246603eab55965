"""Hierarchical residual packing of documents into sequences of at most ``size`` tokens.

Each partition encodes its documents, cuts only those longer than ``size`` (the first piece takes what is
left over, the others are full), and packs its pieces best-fit by falling length, a window of them at a
time; sequences stay open to all windows of their leaf, which is the partition, or ``SEGMENT`` pieces of one that
has more: placed pieces are held in memory, 56 bytes each, until it is known which sequences go up. Nearly full sequences
(within ``slack`` tokens) are final; underfull ones are items of the next round, where groups of ``FAN_IN``
partitions' residues are merged best-fit, and so on up a tree to one root.

A node passes up at most ``PASSED`` sequences, the emptiest; fuller ones become final there. No two of a
node's sequences are at most half full (best fit would have joined them), so that each node has one that
needs a partner, and the rest are only possible partners: the bound costs no join that the tree could
make but for the last few, and keeps any node, the root too, of fixed size.

Defined cases: a null text is an empty one, a piece of the end id alone; long texts give many pieces;
repeated rows are packed each for itself; null identifiers are packed; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LibraryBpe, encoder, in_groups
from .common import documents_of, written

FAN_IN, PASSED = 8, 64
WINDOW, SEGMENT = 200_000, 1_000_000
SEGMENTS = 1 << 20  # of a partition at most
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ROWS = f"{PIECES}, sequence_id long, offset long, open boolean, node long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("node", pa.int64())])

PLACED = pa.schema(list(ARROW)[:7])


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit by falling length (ties: first come): each item's bin and offset, and each bin's fill."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(size + 1)]
    spaces = 0  # bit r: some bin has r tokens of space
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = spaces >> n << n
        if fitting:
            r = (fitting & -fitting).bit_length() - 1
            b = by_space[r].pop()
            if not by_space[r]:
                spaces &= ~(1 << r)
        else:
            b, r = len(fills), size
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += n
        r -= n
        by_space[r].append(b)
        spaces |= 1 << r
    return where, offset, np.array(fills, np.int64)


class Bins:
    """Sequences of one partition over all its windows: each window's pieces are placed best-fit by falling length.

    Pieces come after those that a sequence has, so that of an open one only its name is held, by its space.
    A piece opens a sequence only where it fits none, so that at most one is half full or less and
    the names are no more than twice the leaf's tokens over ``size``."""

    def __init__(self, size: int, first: int):
        self.size, self.next = size, first
        self.by_space = [array("q") for _ in range(size + 1)]
        self.spaces = 0  # bit r: some sequence has r tokens of space

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's sequence and offset."""
        names, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[i])
            fitting = self.spaces >> n << n
            if fitting:
                r = (fitting & -fitting).bit_length() - 1
                name = self.by_space[r].pop()
                if not self.by_space[r]:
                    self.spaces &= ~(1 << r)
            else:
                name, r = self.next, self.size
                self.next += 1
            names[i], offsets[i] = name, self.size - r
            if r > n:
                self.by_space[r - n].append(name)
                self.spaces |= 1 << (r - n)
        return names, offsets

    def emptiest(self, most: int, slack: int) -> np.ndarray:
        """At most so many of the sequences that have more than ``slack`` tokens of space, the emptiest."""
        found: list[int] = []
        for r in range(self.size, slack, -1):
            found += self.by_space[r][: most - len(found)]
        return np.array(found, np.int64)


def still_open(fills: np.ndarray, size: int, slack: int, most: int) -> np.ndarray:
    """Which bins go on to the next round: underfull ones, the emptiest if there are more than ``most``."""
    under = fills < size - slack
    if under.sum() > most:
        order = np.argsort(fills, kind="stable")[:most]
        keep = np.zeros(len(fills), bool)
        keep[order] = True
        under &= keep
    return under


def pack_partitions(documents: DataFrame, tokenizer: str, end_id: int, size: int, slack: int) -> DataFrame:
    """The first round: every piece's sequence within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, node = encoder(tokenizer, LibraryBpe), TaskContext.get().partitionId() * SEGMENTS
        end = int(end_id).to_bytes(4, "little")
        bins, rows = Bins(size, TaskContext.get().partitionId() << 33), []
        held: list[pa.RecordBatch] = []

        def place() -> None:
            names, offsets = bins.place(np.array([r[3] for r in rows], np.int64))
            held.append(pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(zip(*rows), PLACED.types)), pa.array(names), pa.array(offsets)], schema=PLACED))
            rows.clear()

        def leaf() -> Iterator[pa.RecordBatch]:
            """The pieces held, with the sequences that go up; later pieces open others."""
            nonlocal bins, node
            if rows:
                place()
            opened = bins.emptiest(PASSED, slack)
            for batch in held:
                is_open = np.isin(batch.column(5).to_numpy(), opened)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(is_open), pa.array(np.full(len(is_open), node))], schema=ARROW)
            held.clear()
            bins, node = Bins(size, bins.next), node + 1

        for b in batches:
            ids, at = b.column(0).to_pylist(), 0
            for group in in_groups(b.column(1).cast(pa.binary()).to_pylist()):
                for doc_id, data in zip(ids[at : at + len(group)], e.encode(group)):
                    data += end
                    rows += [(doc_id, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(data) // 4, size))]
                at += len(group)
                if len(rows) >= WINDOW:
                    place()
                    if sum(x.num_rows for x in held) >= SEGMENT:
                        yield from leaf()
        yield from leaf()

    return documents_of(documents).mapInArrow(run, ROWS)


def merge_round(residue: DataFrame, size: int, slack: int, last: bool) -> DataFrame:
    """Join the open sequences of each ``FAN_IN`` nodes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bins = rows.groupby("sequence_id", sort=True)["length"].sum()
        where, shift, fills = best_fit(bins.to_numpy(), size)
        opened = np.zeros(len(fills), bool) if last else still_open(fills, size, slack, PASSED)
        place = np.searchsorted(bins.index.to_numpy(), rows["sequence_id"].to_numpy())
        # A joined sequence takes the name of its first part, which no other has.
        name = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(name, where, bins.index.to_numpy())
        return rows.assign(sequence_id=name[where[place]], offset=rows["offset"] + shift[place], open=opened[where[place]], doc_id=rows["doc_id"].astype("Int64"))

    return residue.withColumn("node", F.expr(f"node div {FAN_IN}")).groupBy("node").applyInPandas(run, ROWS)


def pack(documents: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, slack: int = 4) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    level = written(pack_partitions(documents, tokenizer, end_id, size, slack), "pack-0")
    # Leaves are numbered without the gaps that partitions of fewer segments than others leave.
    last, segments = level.agg(F.max(F.expr(f"node div {SEGMENTS}")), F.max(F.col("node") % SEGMENTS) + 1).first()
    level = level.withColumn("node", F.expr(f"(node div {SEGMENTS}) * {segments or 1} + node % {SEGMENTS}"))
    nodes = ((last or 0) + 1) * (segments or 1)
    done, round_ = [], 0
    while nodes > 1:
        done.append(level.where("not open"))
        nodes, round_ = -(-nodes // FAN_IN), round_ + 1
        level = written(merge_round(level.where("open"), size, slack, nodes == 1), f"pack-{round_}")
    for part in done:
        level = level.unionByName(part)
    return level.drop("open", "node")
