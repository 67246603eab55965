"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles as 64-bit hashes. Documents of equal sets are one class and
are expanded at no stage. A class has ``M`` SetSketch registers: register i is the truncated, exponentially
spaced logarithm floor(1 - log_b(least h_i(x))), h_i exponentially distributed; sketches merge by maximum.

1. Registers are banded, ``ROWS`` to a band. Classes that agree on a band are candidates. At similarity 0.8
   all of the 32 bands miss a pair with a probability of 5e-8.
2. Each bucket names as its hub the member with the most neighbours in all its buckets, and proposes
   (member, hub) pairs. A pair is dropped unverified only if the joint likelihood of its registers, at the
   exact set sizes, rules out the threshold by ``SIGMAS`` standard deviations; the rest is confirmed on
   the full sets, within the JVM. Confirmed links form components.
3. Buckets that still hold several components are searched in full, in cells of two blocks of ``BLOCK``
   members: every pair from different components that no earlier band shares is held against its registers,
   and members of pairs that these do not rule out, in blocks of ``BLOCK_BYTES``, against the full sets, so
   that no candidate goes untested. Pairs are formed inside a task; only links leave it.
4. Components of all links, spread to all documents.

Full sets are made anew from the texts of candidates, which a Bloom filter of fixed size picks out while the
texts are read, so that sets are shuffled but texts never are. No bucket is gathered whole: hubs are partial aggregates, written before
the joins on buckets, hubs and components, which Spark can therefore split, and blocks are of bounded size.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; a text of
fewer words than a shingle is one shingle; repeated rows fall in one class; rows that repeat an
identifier count as one document, so their classes are linked; rows with a null identifier get the
component of their class's identified rows, or null; an empty table gives an empty result; columns other
than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents_of, groups, let_go, sifted, strings, written
from .components import components
from .textvec import mixed, shingles, word_hashes

M, ROWS = 128, 4
BANDS = M // ROWS  # a power of two
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
SIGMAS = 5.0
BLOCK, BLOCK_BYTES, SLICE = 512, 4 << 20, 1 << 17
_RNG = np.random.default_rng(20240701)
MULT = _RNG.integers(1, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RNG.integers(0, 2**63, M, dtype=np.uint64)


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    words, at = word_hashes(data, offsets)
    for i in range(len(offsets) - 1):
        yield np.unique(shingles(words[at[i] : at[i + 1]], n))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set."""
    least = np.full(M, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 512):
            np.minimum(least, (hashes[k : k + 512, None] * MULT + PLUS).min(0), out=least)
    # The least of uniform values, as the least of exponential ones of rate RATE.
    x = -np.log1p(-np.minimum((least >> np.uint64(11)).astype(np.float64) + 0.5, 2.0**53 - 1) * 2.0**-53) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def log_likelihood(share: np.ndarray, j: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Of similarity j for registers of which ``above`` are greater in the first set and ``below`` in the second; share: the first set's part of both sizes."""
    u, v = share, 1 - share
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return above * np.log(np.maximum(more, tiny)) + below * np.log(np.maximum(less, tiny)) + (M - above - below) * np.log(np.maximum(1 - more - less, tiny))


def plausible(n_a: np.ndarray, n_b: np.ndarray, regs_a: np.ndarray, regs_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the joint likelihood leaves room for a similarity of ``threshold`` or more.

    Registers agree with a probability of at least the similarity, so that too few that agree, by as many
    standard deviations, rule it out before any likelihood is computed."""
    agree = (regs_a == regs_b).sum(1)
    out = agree >= M * threshold - SIGMAS * math.sqrt(M * threshold * (1 - threshold))
    if out.any() and not out.all():
        side = regs_a[out] if len(regs_a) == len(out) else regs_a
        out[out] = plausible(n_a[out], n_b[out], side, regs_b[out], threshold)
    if not out.all():
        return out
    above, below = (regs_a > regs_b).sum(1), (regs_a < regs_b).sum(1)
    share = n_a / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    best = np.full(len(n_a), -np.inf)
    reached = np.full(len(n_a), -np.inf)
    for step in np.linspace(0, 1, 65):
        j = step * most
        value = log_likelihood(share, j, above, below)
        best = np.maximum(best, value)
        reached = np.where(j >= threshold, np.maximum(reached, value), reached)
    reached = np.maximum(reached, np.where(most >= threshold, log_likelihood(share, np.full(len(n_a), threshold), above, below), -np.inf))
    return (most >= threshold) & (best - reached <= SIGMAS**2 / 2)


def sketch_documents(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key, registers of every row; key and registers null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            data, offsets = strings(b.column(1))
            for i, j in groups(offsets, 1 << 20):
                size, key, regs = [], [], []
                for s in sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n):
                    size.append(len(s))
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    regs.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "set_key", "registers"])

    return documents_of(documents).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, cls) of every band of every class; a bucket's lowest bits name its band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, M))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["bucket", "cls"])

    return classes.select("cls", "registers").mapInArrow(run, "bucket long, cls long")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch, the band's number in its lowest bits."""
    whole = np.ascontiguousarray(regs).view("<u8").reshape(-1, BANDS)
    band = np.arange(BANDS, dtype=np.uint64)
    key = mixed(whole ^ ((band + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    return key & ~np.uint64(BANDS - 1) | band


def likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) pairs that their registers do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n_a, n_b = b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float)
            regs = [np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, M) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(plausible(n_a, n_b, *regs, threshold))) for c in b.columns[:2]], ["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    sketched = written(sketch_documents(documents, n), "near-sketches")
    grouped = sketched.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("registers").alias("registers"))
    classes = written(grouped.withColumn("cls", F.monotonically_increasing_id()), "near-classes")

    buckets = bands(classes)
    # Aggregates are written before a join with many rows of one key: Spark splits a crowded key only where both sides are dealt for the join.
    several = written(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "near-several")
    members = written(buckets.join(several, "bucket"), "near-members")
    discard(several)
    degree = members.groupBy("cls").agg(F.sum("size").alias("degree"))  # a class has 32 buckets at most
    sketches = written(classes.join(degree, "cls").select("cls", "n", "registers", "rep", "set_key"), "near-involved")
    comp = None  # (node, root) of classes in a component of several
    if not sketches.isEmpty():
        sets = written(full_sets(documents, sketches, n), "near-sets")
        hubs = written(members.join(degree, "cls").groupBy("bucket").agg(F.max_by("cls", F.struct("degree", -F.col("cls"))).alias("hub")), "near-hubs")
        pairs = members.join(hubs, "bucket").where("cls <> hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        links = confirmed(pairs, sketches, sets, percent)
        comp = components(links)
        labelled = members.join(comp, F.col("cls") == F.col("node"), "left").select("bucket", "cls", "size", F.coalesce("root", "cls").alias("root"))
        mixed_up = written(labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket"), "near-mixed")
        rest = searched(labelled.join(mixed_up, "bucket"), sketches, sets, percent)
        if not rest.isEmpty():
            both = components(links.unionByName(rest))
            discard(comp)
            comp = both
        discard(links, rest, sets, hubs, mixed_up)
    discard(members, sketches)

    rows = sketched.join(classes.select("set_key", "cls", "rep"), "set_key", "left").select("doc_id", "n_shingles", "cls", "rep")
    if comp is not None:
        rows = rows.join(comp, F.col("cls") == F.col("node"), "left").withColumn("cls", F.coalesce("root", "cls"))
    rows = written(rows.select("doc_id", "n_shingles", "cls", "rep"), "near-rows")
    discard(sketched, classes, comp)
    same = repeated(rows)
    if same is not None:
        rows = rows.join(same, F.col("cls") == F.col("node"), "left").withColumn("cls", F.coalesce("root", "cls")).select("doc_id", "n_shingles", "cls", "rep")
    least = written(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least")), "near-least")
    out = rows.join(least, "cls", "left").withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def searched(labelled: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components within buckets (bucket, cls, size, root), each pair of a bucket's blocks in one bounded cell.

    First by registers alone: members of which no pair is plausible need not bring their sets. What is left is
    dealt into blocks anew, by the bytes of its sets."""
    light = cells(labelled, F.ceil(F.col("size") / BLOCK)).join(sketches.select("cls", "n", "registers"), "cls")

    def sift(cell: Cells) -> pa.Table:
        keep = np.zeros(len(cell.root), bool)
        for x, y in cell.pairs(percent):
            keep[x] = keep[y] = True
        return cell.table.select(["bucket", "cls", "root", "n"]).filter(pa.array(keep))

    left = written(over_cells(light, sift, "bucket long, cls long, root long, n long").distinct(), "near-left")
    bytes_in = written(left.groupBy("bucket").agg(F.sum(F.col("n") * 8).alias("bytes")), "near-bytes")
    heavy = cells(left.join(bytes_in, "bucket"), F.ceil(F.col("bytes") / BLOCK_BYTES))
    full = heavy.join(sketches.select("cls", "n", "registers"), "cls").join(sets.select("cls", "shingles"), "cls")

    def verify(cell: Cells) -> pa.Table:
        lists = cell.table.column("shingles").combine_chunks()
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        ids, out = cell.table.column("cls").to_numpy(), []
        for xs, ys in cell.pairs(percent):
            for x, y in zip(xs.tolist(), ys.tolist()):
                one, other = values[at[x] : at[x + 1]], values[at[y] : at[y + 1]]
                place = np.searchsorted(other, one)
                common = int(np.count_nonzero(other[np.minimum(place, len(other) - 1)] == one))
                if 100 * common >= percent * (len(one) + len(other) - common):
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = written(over_cells(full, verify, "a long, b long").distinct(), "near-rest")
    discard(left, bytes_in)
    return found


def cells(members: DataFrame, blocks) -> DataFrame:
    """(bucket, i, j, g, cls, root): each member, of block g, once for each pair of blocks i <= j that holds its own."""
    placed = members.withColumn("count", blocks.cast("int")).withColumn("g", F.pmod(F.xxhash64("cls"), F.col("count")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    return placed.select("bucket", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "g", "cls", "root")


def over_cells(rows: DataFrame, work: Callable[[Cells], pa.Table], schema: str) -> DataFrame:
    """``work`` on whole cells, many small ones at a time; ``rows`` are dealt by cell and come sorted."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b])
            kept = pa.concat_tables([kept, table]) if kept is not None else table
            edge = cell_starts(kept)
            if len(edge) > 1:  # the last cell may go on in the next batch
                yield from work(Cells(kept.slice(0, edge[-1]), edge[:-1])).to_batches()
                kept = kept.slice(edge[-1])
        if kept is not None and kept.num_rows:
            yield from work(Cells(kept, cell_starts(kept))).to_batches()

    dealt = rows.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "g", "cls")
    return dealt.mapInArrow(run, schema)


def cell_starts(table: pa.Table) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(0, np.int64)
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for name in ("bucket", "i", "j"):
        x = table.column(name).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class Cells:
    """Rows of whole cells, sorted by cell and block; pairs are formed a slice at a time."""

    def __init__(self, table: pa.Table, starts: np.ndarray):
        self.table = table
        column = lambda name: table.column(name).to_numpy()
        self.root, self.size, g = column("root"), column("n").astype(float), column("g")
        self.regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(-1, M)
        self.keys = band_keys(self.regs)
        self.band = (column("bucket") & (BANDS - 1)).astype(np.int64)
        rows = np.arange(table.num_rows)
        end = np.append(starts[1:], table.num_rows)
        cell = np.searchsorted(starts, rows, "right") - 1
        # A row of block i meets the rows of block j: those after it in a cell of one block, else all of j.
        left, one = g == column("i"), column("i") == column("j")
        border = np.add.reduceat(left, starts) + starts if len(starts) else starts
        self.first = np.where(one, rows + 1, border[cell])
        self.count = np.where(left, end[cell] - self.first, 0)

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs from different components that no earlier band shares and that their registers do not rule out."""
        done = np.concatenate([[0], np.cumsum(self.count)])
        at = 0
        while at < len(self.count):
            to = max(at + 1, int(np.searchsorted(done, done[at] + SLICE, "right")) - 1)
            count = self.count[at:to]
            x = np.repeat(np.arange(at, to), count)
            y = np.arange(len(x)) - np.repeat(done[at:to] - done[at], count) + np.repeat(self.first[at:to], count)
            at = to
            big, little = np.maximum(self.size[x], self.size[y]), np.minimum(self.size[x], self.size[y])
            some = (self.root[x] != self.root[y]) & (100 * little >= percent * big)
            x, y = x[some], y[some]
            for k in range(0, len(x), SLICE >> 2):
                u, v = x[k : k + (SLICE >> 2)], y[k : k + (SLICE >> 2)]
                some = (self.keys[u] == self.keys[v]).argmax(1) == self.band[u]  # a pair belongs to its first common band
                u, v = u[some], v[some]
                if len(u):
                    some = plausible(self.size[u], self.size[v], self.regs[u], self.regs[v], percent / 100)
                    yield u[some], v[some]


def repeated(rows: DataFrame) -> DataFrame | None:
    """(node, root) of classes that share an identifier; None if no identifier is in two."""
    twice = rows.where("doc_id is not null and cls is not null").groupBy("doc_id").agg(F.min("cls").alias("b"), F.max("cls").alias("top")).where("b <> top").select("doc_id", "b")
    if twice.isEmpty():
        return None
    return components(rows.join(twice, "doc_id").select(F.col("cls").alias("a"), "b"))


def full_sets(documents: DataFrame, involved: DataFrame, n: int) -> DataFrame:
    """cls, shingles array<long> of the involved classes, each from its documents of least identifier. No text is shuffled."""
    choose = sifted(documents_of(documents), F.col("doc_id"), involved.select(F.col("rep").alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = strings(b.column(1))
            for i, j in groups(offsets, 1 << 20):
                found = [s for s in sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["set_key", "shingles"])

    found = choose(True, run, "set_key binary, shingles array<long>")
    # A row of an identifier that repeats may bring the set of another class, or the same set twice.
    return found.join(involved.select("set_key", "cls"), "set_key").groupBy("set_key", "cls").agg(F.any_value("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), written: the pairs whose full sets reach the threshold."""
    one = lambda x: sketches.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"regs_{x}"))
    sized = pairs.join(one("a"), "a").join(one("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    left = written(likely(sized, percent / 100), "near-likely")
    full = lambda x: sets.select(F.col("cls").alias(x), F.col("shingles").alias(f"set_{x}"))
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    counted = left.join(full("a"), "a").join(full("b"), "b").select("a", "b", common.alias("i"), (F.size("set_a") + F.size("set_b")).cast("long").alias("s"))
    links = written(counted.where(f"100 * i >= {percent} * (s - i)").select("a", "b"), "near-links")
    discard(left)
    return links
