"""Ranked lexical search, document at a time over compressed postings of shards.

``write_index`` cuts the documents, as they are read, into shards of about ``SHARD_BYTES`` bytes of text: no
shuffle. Within a shard documents are numbered by ascending doc_id, and each term has one row of postings:
gaps of these numbers, and the term's occurrences in each document, both in the fewest bytes that a list
needs. One further row a shard holds its documents' identifiers and lengths. The table serves any number of
searches.

``search`` takes items in blocks of ``BLOCK_BYTES``. Of the index it reads the rows of a block's terms, dealt by
shard. Within a shard every item's posting lists are merged document at a time: a heap holds each list's next
document, the least is popped and scored in full, and a heap of ``k`` results, keyed by score and then doc_id,
takes it. The result heap is carried from shard to shard of a task; lists that even together cannot reach its
least score leave the heap and are only probed for documents that the others bring (no document is lost: the
bounds are the lists' greatest true contributions). Tasks' heaps are merged over all shards at the end.

All counts (documents with terms, all terms, documents a term) are of the whole table.

Defined cases: a null or termless text has no term, counts for nothing and is never found; rows that repeat
an identifier, or have none, are documents of their own, a missing identifier ordered last; each row of
items is ranked for itself; items without a found term have no row; columns other than doc_id and text, item_id
and text are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, let_go, written

SHARD_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20
#: Letters A-Z in lower case; bytes that part terms as a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "shard long, term binary, df long, total long, postings binary"
WIDTHS = [np.dtype(x) for x in ("<u1", "<u2", "<u4", "<u8")]


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of digits, letters and characters beyond ASCII."""
    return text.translate(TABLE).split()


def places(most: np.ndarray) -> np.ndarray:
    """For each greatest number, the fewest bytes it takes, as a place in WIDTHS."""
    return np.searchsorted([np.iinfo(t).max for t in WIDTHS[:-1]], most)


def compressed(ords: np.ndarray, tf: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Lists of ascending document numbers as gaps, then of occurrences; list i is of places at[i] to at[i + 1]."""
    if len(at) < 2:
        return []
    gaps = np.diff(ords, prepend=0)
    gaps[at[:-1]] = ords[at[:-1]]
    wide = [places(np.maximum.reduceat(x, at[:-1])) for x in (gaps, tf)]
    kept = [[x.astype(t).tobytes() if (w == i).any() else b"" for i, t in enumerate(WIDTHS)] for x, w in zip((gaps, tf), wide)]
    out, i = [], 0
    for a, b, j in zip(wide[0].tolist(), wide[1].tolist(), at[1:].tolist()):
        out.append(bytes((a << 4 | b,)) + kept[0][a][i << a : j << a] + kept[1][b][i << b : j << b])
        i = j
    return out


def expand(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    gap, count = WIDTHS[data[0] >> 4], WIDTHS[data[0] & 15]
    n = (len(data) - 1) // (gap.itemsize + count.itemsize)
    ords = np.frombuffer(data, gap, n, 1).astype(np.int64).cumsum()
    return ords, np.frombuffer(data, count, n, 1 + n * gap.itemsize).astype(np.int64)


def shard_rows(shard: int, docs: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple[int, bytes | None, int, int, bytes]]:
    """A shard's rows of the index: first its documents, without a term, then its terms in byte order."""
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    known: dict[bytes, int] = {}
    numbers, lengths = [], np.array([len(t) for _, t in docs], np.int64)
    for _, terms in docs:
        numbers += [known.setdefault(t, len(known)) for t in terms]
    have = np.array([i is not None for i, _ in docs])
    ids = np.array([i or 0 for i, _ in docs], np.int64)
    yield shard, None, len(docs), int(lengths.sum()), np.int64(have.sum()).tobytes() + ids.tobytes() + lengths.tobytes()
    key = np.array(numbers, np.int64) * len(docs) + np.repeat(np.arange(len(docs)), lengths)
    key, tf = np.unique(key, return_counts=True)
    of, ords = np.divmod(key, len(docs))
    at = np.searchsorted(of, np.arange(len(known) + 1))
    lists, df, total = compressed(ords, tf, at), np.diff(at).tolist(), np.add.reduceat(tf, at[:-1]).tolist()
    for term, n in sorted(known.items()):
        yield shard, term, df[n], total[n], lists[n]


def write_index(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index, as a written table. df and total of a row without a term are the shard's documents and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        shard = TaskContext.get().partitionId() << 32  # the same when a lost task runs again
        held: list[tuple[int | None, list[bytes]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, held, size
            rows = []
            for row in shard_rows(shard, held) if held else ():
                rows.append(row)
                if len(rows) == 8192:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
            shard, held, size = shard + 1, [], 0

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_buffer()
                if text is not None and (terms := terms_of(text.to_pybytes())):
                    held.append((i, terms))
                    size += text.size
                    if size >= shard_bytes:
                        yield from flush()
        yield from flush()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["shard", "term", "df", "total", "postings"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(docs.mapInArrow(run, INDEX), "lexical-index")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Postings:
    """A term's documents in a shard, and what each adds to a score."""

    def __init__(self, data: bytes, w: int, m: np.ndarray):
        ords, tf = expand(data)
        score = w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[ords]))
        self.ords, self.scores, self.most = ords.tolist(), score.tolist(), int(score.max(initial=0))


def merge_heap(lists: list[tuple[Postings, int]], rank: list[tuple[int, int]], found: list[tuple], k: int) -> None:
    """Offer every document of (postings, times) ``lists`` that can be among ``k`` to the heap ``found`` of (score, -class, -doc_id); ``rank``: the last two of each document."""
    lists = sorted(lists, key=lambda x: x[0].most * x[1])
    bounds = [0]
    for p, times in lists:
        bounds.append(bounds[-1] + p.most * times)
    least = found[0][0] if len(found) == k else 1
    first = 0  # lists before it cannot reach the least score together
    while first < len(lists) and bounds[first + 1] < least:
        first += 1
    heap = [(p.ords[0], i, 0) for i, (p, _) in enumerate(lists) if i >= first]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            _, i, at = heap[0]
            p, times = lists[i]
            score += p.scores[at] * times
            at += 1
            if at < len(p.ords):
                heapq.heapreplace(heap, (p.ords[at], i, at))
            else:
                heapq.heappop(heap)
        for i in range(first - 1, -1, -1):
            if score + bounds[i + 1] < least:
                break
            p, times = lists[i]
            at = bisect_left(p.ords, doc)
            if at < len(p.ords) and p.ords[at] == doc:
                score += p.scores[at] * times
        if score < least:
            continue
        entry = (score, *rank[doc])
        if len(found) < k:
            heapq.heappush(found, entry)
        elif entry > found[0]:
            heapq.heapreplace(found, entry)
        if len(found) == k and found[0][0] > least:
            least, before = found[0][0], first
            while first < len(lists) and bounds[first + 1] < least:
                first += 1
            if first > before:
                heap = [x for x in heap if x[1] >= first]
                heapq.heapify(heap)


def blocks_of(items: DataFrame, most: int) -> Iterator[list[tuple[int, Counter]]]:
    """(item, its terms) of all items, in blocks of about ``most`` bytes of text; no more is held at once."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r.item, Counter(terms_of(r.text.encode()))))
        size += len(r.text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = index.sparkSession
    whole = index.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("l")).first()
    named = written(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "lexical-items")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = [written(ranked(index, block, whole.n, whole.l, k, tasks), "lexical-block") for block in blocks_of(named, block_bytes)] if whole.n else []
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranked(index: DataFrame, block: list[tuple[int, Counter]], n: int, total: int, k: int, tasks: int) -> DataFrame:
    """item, doc_id, score: each task's ``k`` best documents of each item of one block."""
    spark = index.sparkSession
    terms = sorted(set().union(*(t for _, t in block)))
    wanted = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(terms, pa.binary())})))  # a block's terms: BLOCK_BYTES and one item at most
    rows = index.join(wanted, "term", "left_semi")
    weights = {bytes(r.term): weight(n, r.df) for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # of a block's terms
    asked = [(item, [(t, c) for t, c in terms.items() if weights.get(t, 0) > 0]) for item, terms in block]
    shared = spark.sparkContext.broadcast((asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        best: dict[int, list[tuple]] = {}
        shard, rank, m, lists = None, [], np.zeros(0, np.int64), {}

        def merge() -> None:
            for item, terms in asked:
                if mine := [(lists[t], c) for t, c in terms if t in lists]:
                    merge_heap(mine, rank, best.setdefault(item, []), k)

        for b in batches:
            for s, term, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = data.as_buffer().to_pybytes()
                if s != shard:
                    merge()
                    shard, lists = s, {}
                    have, ids, lengths = int(np.frombuffer(data, np.int64, 1)[0]), *np.frombuffer(data, np.int64, -1, 8).reshape(2, -1)
                    rank = [(0, -i) for i in ids[:have].tolist()] + [(-1, 0)] * (len(ids) - have)
                    m = 75 + (25 * lengths * n) // total
                elif weights.get(term, 0) > 0:
                    lists[term] = Postings(data, weights[term], m)
        merge()
        out = [(item, None if none else -doc, score) for item, heap in best.items() for score, none, doc in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["item", "doc_id", "score"])

    mine = rows.unionByName(index.where("term is null")).select("shard", "term", "postings")
    dealt = mine.repartition(tasks, "shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
    return dealt.mapInArrow(run, "item long, doc_id long, score long")


def lexical_search(documents: DataFrame, items: DataFrame, k: int = 20, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: write the index of ``documents``, then search it for all ``items``."""
    return search(write_index(documents, shard_bytes), items, k, block_bytes)
