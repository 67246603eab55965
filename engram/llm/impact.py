"""Exact top-k inner products from an impact-ordered index, score at a time.

Components are quantised to floor(64 * x). A shard of at most ``SHARD_ROWS`` rows keeps one posting list a
component, its rows in order of their quantised values, so that the postings of one impact are one segment and the
greatest impacts, of either sign, are at the ends. For ``TOGETHER`` queries at a time, segments of all lists are processed by
descending impact, level by level, each added to the accumulators of its rows, one for every query. After a level a row's
score lies within what the lists still hold: at most the sum of their greatest remaining gains above its accumulator, at
most the sum of their greatest remaining losses below. Rows whose upper bound is under the k-th best lower bound, or under
the k-th best score of the shards before, are proven to be no members; the walk stops once so few possible members are
left that scoring them exactly costs less than the postings to come, and those are scored exactly, from the stored
values. Nothing is stopped without that proof, so that results are exact.

Spans of shards and groups of queries meet once each, in cells of bounded size: a shard is sent once to every group of queries,
and a cell walks its shards one after the other. Each cell returns ``k`` rows a query.

Defined cases: vectors that are null, empty, of another length than the most common one (ties: the shorter), or
hold null or non-finite components, or ones of which scores could pass 64 bits, take no part, nor do rows with a
null identifier; zero vectors do; of rows that repeat a query's identifier one, of the least vector, is the query, and
none is a candidate for it; other repeated identifiers are candidates each for itself; equal scores are ordered
by vec_id; with fewer than k candidates all are returned; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

SCALE = 64
SHARD_ROWS, GROUP_QUERIES, TOGETHER, SPAN = 1 << 16, 1 << 12, 128, 8
LEAST_SHARD, CELLS = 4096, 64
NONE = -(1 << 62)  # below every score


def quantised(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, units array<long> of the rows that take part, and their length."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    x = x.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    size = x.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not size:
        return x, 0
    most = math.isqrt((1 << 62) // size.n)
    x = x.where(F.size("embedding") == size.n).where(F.forall("embedding", lambda v: F.abs(v) < most / SCALE - 1))
    return x.select("vec_id", F.transform("embedding", lambda v: F.floor(v * SCALE).cast("long")).alias("units")), size.n


class Shard:
    """Posting lists of one shard: ``rows[d]`` in ascending order of ``values[d]``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray):
        self.ids, self.rows, self.values = ids, rows.astype(np.intp), values.astype(np.int64)
        self.size, self.n = values.shape
        self.units = np.empty((self.n, self.size), np.int64)
        self.units[self.rows, np.arange(self.size)[:, None]] = self.values
        # All lists as one ascending array, for one binary search a level.
        self.low = int(self.values.min())
        self.span = int(self.values.max()) - self.low + 2
        self.wide = self.span * (self.size + 1) >= 1 << 62
        self.flat = None if self.wide else (self.values - self.low + self.span * np.arange(self.size)[:, None]).ravel()

    def place(self, bound: np.ndarray) -> np.ndarray:
        """For each list, how many of its values are below ``bound``."""
        if self.wide:
            return np.array([np.searchsorted(v, b) for v, b in zip(self.values, bound)])
        steps = np.arange(self.size)
        bound = np.clip(bound - self.low, 0, self.span - 1)
        return np.searchsorted(self.flat, bound + self.span * steps) - self.n * steps

    def best(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, identifier, score) of the k best rows of each query (a row of ``q``) but those of its own identifier, of scores of at least ``floor``."""
        count = len(q)
        most = int(np.abs(self.values).max()) * int(np.abs(q).max()) * self.size
        kind = np.int32 if most < 1 << 30 else np.int64
        weights = np.ascontiguousarray(q.T.astype(kind))  # a list's factors for all queries
        values = self.values.astype(kind)
        lists = np.arange(self.size)
        lo, hi = np.zeros(self.size, np.int64), np.full(self.size, self.n)
        acc = np.zeros((self.n, count), kind)
        mine = [np.flatnonzero(self.ids == i) for i in own.tolist()]
        level = int(max(abs(int(self.values.min())), abs(int(self.values.max()))))
        while True:
            level = level * 2 // 3
            least = np.full(self.size, max(level, 1))  # values from it on, of either sign, are of this level or above
            new_lo, new_hi = np.maximum(lo, self.place(1 - least)), np.minimum(hi, self.place(least))
            for d in lists:
                for a, b in ((lo[d], new_lo[d]), (new_hi[d], hi[d])):
                    if a < b:
                        acc[self.rows[d, a:b]] += values[d, a:b, None] * weights[d]
            lo, hi = new_lo, new_hi
            # What the lists hold between lo and hi: by how much each query's scores can still rise or fall.
            some = lo < hi
            ends = [np.where(some, self.values[lists, at], 0) * q for at in (np.maximum(hi - 1, 0), np.minimum(lo, self.n - 1))]
            rise, fall = (np.maximum(np.maximum(sign * ends[0], sign * ends[1]), 0).sum(1) for sign in (1, -1))
            left = float((hi - lo).sum()) / (self.n * self.size) if (rise + fall).any() else 0.0
            if left > 0.5 and level > 1:
                continue  # most postings are still to come
            for j, rows in enumerate(mine):
                acc[rows, j] = np.iinfo(kind).min >> 1
            bound = floor - rise
            if (floor == NONE).any() and self.n > k:
                here = np.partition(acc, self.n - k, axis=0)[self.n - k] - fall - rise
                bound = np.maximum(bound, here)
            possible = acc >= np.maximum(bound, np.iinfo(kind).min >> 2).astype(kind)
            if left and np.count_nonzero(possible) > left / 2 * possible.size:
                for j, rows in enumerate(mine):
                    acc[rows, j] = 0  # never looked at again without the mark above
                continue
            place, row = np.nonzero(possible.T)
            score = np.zeros(len(row), np.int64)
            for i in range(0, len(row), 1 << 15):
                score[i : i + (1 << 15)] = np.einsum("ij,ij->i", self.units[row[i : i + (1 << 15)]], q[place[i : i + (1 << 15)]])
            keep = np.flatnonzero(score >= floor[place])
            place, score, ids = place[keep], score[keep], self.ids[row[keep]]
            order = np.lexsort((ids, -score, place))
            place, score, ids = place[order], score[order], ids[order]
            first = np.arange(len(place)) - np.searchsorted(place, place) < k
            return place[first], ids[first], score[first]


def narrowed(values: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold all values, its item size telling how many."""
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if values.min(initial=0) >= np.iinfo(t).min and values.max(initial=0) <= np.iinfo(t).max))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def write_index(units: DataFrame, size: int, shard_rows: int) -> tuple[DataFrame, int]:
    """shard, ids, rows, width, values: one row a shard, as a written table; and how many shards there are."""
    rows = written(units.withColumn("row", F.monotonically_increasing_id()), "impact-rows")
    shards = max(1, -(-rows.count() * 9 // (8 * shard_rows)))  # an eighth to spare, since rows are dealt by hash
    tasks = max(1, min(shards, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shard = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, x = (np.concatenate(c) for c in zip(*held))
            for i in range(0, len(ids), SHARD_ROWS):  # positions are of two bytes
                part = np.ascontiguousarray(x[i : i + SHARD_ROWS].T)
                order = np.argsort(part, 1, kind="stable").astype("<u2")
                values = narrowed(np.take_along_axis(part, order.astype(np.intp), 1))
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([ids[i : i + SHARD_ROWS].tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary()), pa.array([values.itemsize], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["shard", "ids", "rows", "width", "values"])

        for b in batches:
            of = b.column(0).to_numpy()
            for i, j in edges(of):
                if of[i] != shard:
                    yield from flush()
                    shard, held = int(of[i]), []
                held.append((b.column(1).slice(i, j - i).to_numpy(), matrix(b.column(2).slice(i, j - i), size)))
        yield from flush()

    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "vec_id", "units").repartition(tasks, "shard").sortWithinPartitions("shard")
    index = written(dealt.mapInArrow(build, "shard long, ids binary, rows binary, width int, values binary"), "impact-index")
    discard(rows)
    return index, shards


def edges(of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal values."""
    at = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]) if len(of) else np.zeros(1, int)
    return zip(at[:-1].tolist(), at[1:].tolist())


def top_products(embeddings: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose identifier is divisible by ``every``."""
    spark = embeddings.sparkSession
    units, size = quantised(embeddings)
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = written(units.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("units").alias("units")), "impact-queries")
    n, total = asked.count(), units.count()
    # On small tables, shards and groups enough for all cores; on large ones, of full size.
    index, shards = write_index(units, size, max(1, min(shard_rows, max(LEAST_SHARD, total // CELLS))))
    groups = max(1, -(-n // max(1, min(group_queries, max(TOGETHER, n // 8)))))
    spans = -(-shards // SPAN)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(spans * groups, CELLS))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    left = index.select(F.expr(f"shard div {SPAN}").alias("span"), F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("g"), "shard", *none("long", "query_id"), *none("array<long>", "units"), "ids", "rows", "width", "values")
    right = asked.select(F.explode(F.expr(f"sequence(0L, {spans - 1}L)")).alias("span"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("g"), *none("long", "shard"), F.col("vec_id").alias("query_id"), "units", *none("binary", "ids", "rows"), *none("int", "width"), *none("binary", "values"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own, q = None, [], []
        best: dict[int, list[tuple[int, int]]] = {}

        def found() -> Iterator[pa.RecordBatch]:
            rows = [(i, v, -s) for i, list_ in best.items() for s, v in list_]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                here = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if here != cell:
                    yield from found()
                    cell, own, q, best = here, [], [], {}
                if (query := b.column(3)[i].as_py()) is not None:
                    own.append(query)
                    q.append(b.column(4)[i].values.to_numpy())
                    continue
                ids, rows, width, values = (b.column(c)[i].as_py() for c in (5, 6, 7, 8))
                shard = Shard(np.frombuffer(ids, np.int64), np.frombuffer(rows, "<u2").reshape(size, -1), np.frombuffer(values, f"<i{width}").reshape(size, -1))
                for j in range(0, len(own), TOGETHER):
                    some = own[j : j + TOGETHER]
                    floor = np.array([-best[x][-1][0] if len(best.get(x, ())) == k else NONE for x in some], np.int64)
                    for place, vec_id, score in zip(*(x.tolist() for x in shard.best(np.stack(q[j : j + TOGETHER]), np.array(some), k, floor))):
                        best.setdefault(some[place], []).append((-score, vec_id))
                    for x in some:
                        if x in best:
                            best[x] = sorted(best[x])[:k]
        yield from found()

    # A cell's queries come before its shards.
    cells = left.unionByName(right).repartition(tasks, "span", "g").sortWithinPartitions("span", "g", F.asc_nulls_first("shard"))
    hits = cells.mapInArrow(walk, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
