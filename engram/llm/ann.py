"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample (``sample`` rows and ``SAMPLE_VALUES`` numbers at most, those of least
identifier hash), and every row is assigned to a leaf. A query walks the tree best bin first: from the root
to the nearest child, the others into a priority queue by distance, again and again from the queue's head,
until it has visited enough leaves. Tables of 64 rows or more have several. How many is calibrated: for a bounded number of queries the true
neighbours are found by brute force over all rows, in blocks, and leaf visits widen until ``target`` of them
lie in the visited leaves. Then all queries are searched, leaf by leaf; a leaf with many rows or visits is
split into parts, so that no task gathers more than a bounded group.

Defined cases: vectors that are null, zero, of another length than the most common one (ties: the shorter),
or hold null or non-finite components take no part, nor do rows with a null identifier; of rows that repeat
a query's identifier one, of the least vector in byte order, is the query, and none is a candidate for it;
other repeated identifiers are candidates each for itself; equal distances are ordered by vec_id; with
fewer than k candidates all are returned; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE_VALUES = 4_000_000
LEAF_ROWS, MOST_LEAVES, BRANCHES = 512, 4096, 8
GROUP_ROWS, GROUP_QUERIES = 4096, 1024


@dataclass
class Tree:
    """Inner nodes have centres and children (child < 0: leaf -child - 1)."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf: the nearest child, from the root down."""
        leaf, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo and self.centres:
            node, rows = todo.pop()
            near = nearest(x[rows], self.centres[node])
            for c, child in enumerate(self.children[node]):
                if len(mine := rows[near == c]):
                    if child < 0:
                        leaf[mine] = -child - 1
                    else:
                        todo.append((child, mine))
        return leaf

    def order(self, q: np.ndarray) -> Iterator[int]:
        """Leaves best bin first."""
        if not self.centres:
            yield 0
            return
        queue, node = [], 0
        while True:
            while node >= 0:
                away = ((self.centres[node] - q) ** 2).sum(1)
                best = int(away.argmin())
                for c, child in enumerate(self.children[node]):
                    if c != best:
                        heapq.heappush(queue, (float(away[c]), child))
                node = self.children[node][best]
            yield -node - 1
            if not queue:
                return
            node = heapq.heappop(queue)[1]

    def visits(self, q: np.ndarray, least: int, sizes: np.ndarray, k: int) -> list[int]:
        """The first ``least`` leaves, and more until they hold over k rows."""
        out, held = [], 0
        for leaf in self.order(q):
            out.append(leaf)
            held += int(sizes[leaf])
            if len(out) >= least and held > k:
                break
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def grow(sample: np.ndarray, leaves: int, seed: int = 7, rounds: int = 8) -> Tree:
    """Split the largest parts by k-means until there are about ``leaves`` of them."""
    rng, tree = np.random.default_rng(seed), Tree()
    parts: list[tuple[int, int, np.ndarray, tuple[int, int] | None]] = [(-len(sample), 0, np.arange(len(sample)), None)]
    made = 1
    done: list[tuple[np.ndarray, tuple[int, int] | None]] = []
    while parts:
        if len(parts) + len(done) + BRANCHES - 1 > leaves:
            done += [(p[2], p[3]) for p in parts]
            break
        _, _, rows, at = heapq.heappop(parts)
        x = sample[rows]
        distinct = np.unique(x, axis=0)
        if len(distinct) < 2 * BRANCHES:
            done.append((rows, at))
            continue
        centres = distinct[rng.choice(len(distinct), BRANCHES, replace=False)]
        for _ in range(rounds):
            near = nearest(x, centres)
            for c in range(BRANCHES):
                if (near == c).any():
                    centres[c] = x[near == c].mean(0)
        near = nearest(x, centres)
        used = [c for c in range(BRANCHES) if (near == c).any()]
        if len(used) < 2:
            done.append((rows, at))
            continue
        node = len(tree.centres)
        tree.centres.append(centres[used])
        tree.children.append([0] * len(used))
        if at:
            tree.children[at[0]][at[1]] = node
        for i, c in enumerate(used):
            mine = rows[near == c]
            heapq.heappush(parts, (-len(mine), made, mine, (node, i)))
            made += 1
    for i, (_, at) in enumerate(done):
        if at:
            tree.children[at[0]][at[1]] = -i - 1
    tree.leaves = max(1, len(done))
    return tree


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, embedding array<double> of the rows that take part, and their length."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    x = x.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    size = x.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (x.where(F.size("embedding") == size.n), size.n) if size else (x, 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of packed doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def packed(x: DataFrame, tree: Tree, size: int) -> DataFrame:
    """vec_id, leaf, vector binary of every row."""
    shared = x.sparkSession.sparkContext.broadcast(tree)  # MOST_LEAVES centres at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).flatten().to_numpy().reshape(b.num_rows, size)
            for i in range(0, len(rows), 4096):
                part = np.ascontiguousarray(rows[i : i + 4096])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array(shared.value.assign(part), pa.int32()), pa.array([r.tobytes() for r in part], pa.binary())], ["vec_id", "leaf", "vector"])

    return x.mapInArrow(run, "vec_id long, leaf int, vector binary")


def top(q: np.ndarray, q_id: int, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows, ties by identifier."""
    with np.errstate(over="ignore"):
        d = np.sqrt(((x - q) ** 2).sum(1))  # of finite vectors; infinite where the sum is, and ordered last
    others = np.flatnonzero(ids != q_id)
    near = others[d[others] <= np.partition(d[others], k - 1)[k - 1]] if len(others) > k else others
    near = near[np.lexsort((ids[near], d[near]))][:k]
    return near, d[near]


def true_leaves(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> dict[int, list[int]]:
    """For a bounded number of queries, the leaves of their k true neighbours among all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, int]]] = {q: [] for q, _ in shared.value}
        for b in batches:
            ids, leaf = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = matrix(b.column(2)) if len(ids) else np.zeros((0, 1))
            for q_id, q in shared.value if len(ids) else ():
                near, d = top(q, q_id, ids, x, k)
                best[q_id] = sorted(best[q_id] + list(zip(d.tolist(), ids[near].tolist(), leaf[near].tolist())))[:k]
        out = [(q, d, v, n) for q, found in best.items() for d, v, n in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.float64(), pa.int64(), pa.int32()])], ["q", "d", "v", "leaf"])

    found = rows.mapInArrow(run, "q long, d double, v long, leaf int")
    order = Window.partitionBy("q").orderBy("d", "v")
    out: dict[int, list[int]] = {}
    for r in found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k).collect():
        out.setdefault(r.q, []).append(r.leaf)
    return out


def nearest_neighbours(embeddings: DataFrame, every: int = 100, k: int = 10, target: float = 0.96, sample: int = 20_000, calibration: int = 200) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose identifier is divisible by ``every``.

    calibrated_recall, the same in every row, is the share of true neighbours in the leaves visited, of those calibration
    queries that did not choose the number of visits (of the one that did, if there is but one); null without any."""
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double, calibrated_recall double"
    x, size = usable(embeddings)
    if not size:
        return spark.createDataFrame([], schema)
    total = x.count()
    most = min(sample, max(1000, SAMPLE_VALUES // size))
    chosen = np.array([r.embedding for r in x.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(most).collect()], np.float64)
    tree = grow(chosen, leaves_for(total, len(chosen)))
    rows = written(packed(x, tree, size), "ann-rows")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():  # MOST_LEAVES rows at most
        sizes[r.leaf] = r["count"]
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    some = [(r.vec_id, np.frombuffer(r.vector, "<f8")) for r in queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(calibration).collect()]
    # Half of the queries choose the visits, the other half, if there is one, tell the recall.
    true = true_leaves(rows, some, k)
    visits, recall = calibrated(tree, some[::2], true, target)
    recall = recall_at(tree, some[1::2], true, visits) if len(some) > 1 else recall

    shared = spark.sparkContext.broadcast((tree, sizes))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sizes = shared.value
        for b in batches:
            for i in range(b.num_rows):
                vector = b.column(1)[i].as_py()
                leaves = tree.visits(np.frombuffer(vector, "<f8"), visits, sizes, k)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(leaves), pa.int64()), pa.array([vector] * len(leaves), pa.binary()), pa.array(leaves, pa.int32())], ["query_id", "query", "leaf"])

    walked = written(queries.mapInArrow(walk, "query_id long, query binary, leaf int"), "ann-visits")
    asked = np.zeros(tree.leaves, np.int64)
    for r in walked.groupBy("leaf").count().collect():
        asked[r.leaf] = r["count"]
    # A large leaf is dealt into parts by rows, much visited ones also by queries; each pair meets once.
    by_row, by_query = np.maximum(1, -(-sizes // GROUP_ROWS)), np.maximum(1, -(-asked // GROUP_QUERIES))
    parts = F.broadcast(spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(by_row, by_query))], "leaf int, by_row int, by_query int"))
    left = rows.join(parts, "leaf").where("by_query > 0").select("leaf", F.pmod(F.xxhash64("vec_id"), "by_row").cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("by_query") - 1)).alias("s"), "vec_id", "vector")
    right = walked.join(parts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("by_row") - 1)).alias("p"), F.pmod(F.xxhash64("query_id"), "by_query").cast("int").alias("s"), "query_id", "query")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids, m = a["vec_id"].to_numpy(), np.frombuffer(b"".join(a["vector"]), "<f8").reshape(len(a), -1)
            for q_id, q in zip(b["query_id"], b["query"]):
                near, d = top(np.frombuffer(q, "<f8"), q_id, ids, m, k)
                out.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[near], "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ["leaf", "p", "s"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(recall).cast("double").alias("calibrated_recall"))


def leaves_for(rows: int, sampled: int) -> int:
    """Leaves of about LEAF_ROWS rows, at least a first split, and of eight sampled rows at least; one for under 64 rows."""
    return int(min(MOST_LEAVES, max(BRANCHES, rows // LEAF_ROWS), max(1, sampled // 8)))


def places_in(tree: Tree, queries: list[tuple[int, np.ndarray]], true: dict[int, list[int]]) -> np.ndarray:
    """For each true neighbour, after how many leaf visits it is found."""
    at = []
    for q_id, q in queries:
        place = {leaf: i for i, leaf in enumerate(tree.order(q), 1)}
        at += [place[leaf] for leaf in true.get(q_id, ())]
    return np.sort(np.array(at, np.int64))


def calibrated(tree: Tree, queries: list[tuple[int, np.ndarray]], true: dict[int, list[int]], target: float) -> tuple[int, float | None]:
    """The least number of leaf visits that finds ``target`` of the true neighbours, and the share that it finds."""
    at = places_in(tree, queries, true)
    if not len(at):
        return 1, None
    visits = int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)])
    return visits, float(np.mean(at <= visits))


def recall_at(tree: Tree, queries: list[tuple[int, np.ndarray]], true: dict[int, list[int]], visits: int) -> float | None:
    """The share of the queries' true neighbours that so many leaf visits find."""
    at = places_in(tree, queries, true)
    return float(np.mean(at <= visits)) if len(at) else None
