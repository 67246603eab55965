"""Repeated passages, by merging Burrows-Wheeler transforms of shards.

Every byte covered by a ``LENGTH``-byte string that starts in two places is removed. The steps:

1. Cut: the windows of LENGTH bytes of a text fall into runs whose least hash of ``SEED`` of a window is the
   same. Equal windows have equal least hashes, so a run need only be held against runs of its own hash, and
   most hashes occur once: their runs are done, unless the hash recurs within the run (a periodic passage).
2. Runs with equal bytes are repeated as a whole; they are counted, not gathered.
3. What is left are runs of different bytes under one hash, each distinct one once. Hashes with many of
   them are cut again by longer parts of the window, and equal cuts counted again, level by level: at the last
   one a cut is a single window, of which one under a hash is left. So no group is large.
4. In groups of whole hashes: texts become chains of ``STEP``-byte symbols, one chain for each residue, so
   that every position has its suffix. Each shard's transform is built on its own; the transforms are merged
   by interleave refinement, in which pass t orders the merged suffixes by t symbols by one stable
   distribution of the transforms' symbols, and boundaries first seen in pass t have a common prefix of
   t - 1 symbols. Suffixes whose common prefix with a neighbour is LENGTH / STEP symbols or more form the
   repeated intervals.
5. Found windows are joined back to their documents. Texts that have none, as a filter of fixed size tells,
   are not shuffled.

Defined cases: a null text is an empty one; texts under LENGTH bytes keep everything; matches never cross
documents; the same document counts as another place; repeated rows are copies of each other, so all
of their windows are repeated; rows with a null identifier take part; an empty table gives an empty
result; columns other than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents_of, let_go, sifted, strings, written
from .textvec import BYTE_VALUE, _MULT, mixed

LENGTH, STEP = 400, 100
#: The part of a window whose least hash names its run.
SEED = 0.25
#: For each further level: distinct runs under a hash from which it is cut again, and the part of the window.
SPLITS = ((500, 0.84), (500, 0.96), (500, 1.0))
SHARD_BYTES, GROUP_BYTES = 1 << 17, 1 << 20
#: Bytes of texts in a batch of results.
OUT_BYTES = 1 << 22


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k bytes."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, size, m = BYTE_VALUE[data], 1, int(_MULT)
    total, got = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                total = part[:n] if total is None else total * np.uint64(m) + part[got : got + n]
                got += size
            if size * 2 > k:
                return mixed(total)
            part = part[:-size] * np.uint64(m) + part[size:]
            m, size = m * m % 2**64, size * 2


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    rest = width - k
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def cut_runs(data: np.ndarray, length: int, seed: int) -> Iterator[tuple[int, int, int, bool]]:
    """(least hash, first window, windows, whether the hash recurs in the run) of a text's runs."""
    if len(data) < length:
        return
    width = length - seed + 1
    h = kmer_hashes(data, seed)
    least = sliding_least(h, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(first, len(least)))
    for a, n, v in zip(first.tolist(), count.tolist(), least[first]):
        yield int(v.view(np.int64)), a, n, bool(np.count_nonzero(h[a : a + n + width - 1] == v) > 1)


def stable_order(x: np.ndarray) -> np.ndarray:
    """The stable order of non-negative numbers under 2^32, by two distributions of 16 bits."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]


class Transform:
    """A shard's suffix order and Burrows-Wheeler transform over chains of symbols. Row 0 to ``ends`` are the chains' ends."""

    def __init__(self, symbol: np.ndarray, after: np.ndarray, before: np.ndarray):
        """symbol: of each position, 0 for an end; after: the next position of its chain; before: the symbol before it, 0 for none."""
        n = len(symbol)
        self.ends = int((symbol == 0).sum())
        rank = np.empty(n, np.int64)
        end = symbol == 0
        rank[end] = np.arange(self.ends)  # ends differ from each other and from all else
        rank[~end] = self.ends + symbol[~end]
        while True:
            _, rank = np.unique(rank * np.int64(1 << 32) + rank[after], return_inverse=True)
            if rank.max(initial=0) + 1 == n:
                break
            after = after[after]
        self.order = np.empty(n, np.int32)
        self.order[rank] = np.arange(n, dtype=np.int32)
        self.symbols = before[self.order]


def merge(shards: list[Transform], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement: for each merged row its row among all shards' rows, and how many symbols it shares with the row before, up to ``passes``."""
    sizes = [len(s.order) for s in shards]
    symbols = np.concatenate([s.symbols for s in shards])
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    ends = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.ends for s in shards])
    n, k = len(z), len(ends)
    interval, prefix = np.zeros(n, np.int32), np.full(n, passes, np.int16)
    merged = np.empty(n, np.int32)
    for t in range(1, passes + 1):
        merged[np.argsort(z, kind="stable")] = symbols  # each shard's symbols in turn, as the interleave calls them
        kept = np.flatnonzero(merged)
        order = kept[stable_order(merged[kept])]
        z = np.concatenate([ends, z[order]])
        s, o = merged[order], interval[order]
        new = np.ones(n, bool)
        new[k + 1 :] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
        prefix[new & (prefix == passes)] = t - 1
        interval = (np.cumsum(new) - 1).astype(np.int32)
    row = np.empty(n, np.int32)
    row[np.argsort(z, kind="stable")] = np.arange(n, dtype=np.int32)
    return row, prefix


def repeated_windows(texts: list[np.ndarray], length: int, step: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each text, which of its windows start in two places among all the texts."""
    passes = length // step
    sizes = np.array([len(t) for t in texts], np.int64)
    ranks = np.unique(np.concatenate([kmer_hashes(t, step) for t in texts]), return_inverse=True)[1].astype(np.int32)
    shards: list[Transform] = []
    place: list[tuple[np.ndarray, np.ndarray]] = []  # of each shard's rows: text and position
    used, first = 0, 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + sizes[last] <= shard_bytes):
            size += sizes[last]
            last += 1
        symbol, after, before, text, position = [], [], [], [], []
        base = 0
        for i in range(first, last):
            m = int(sizes[i])
            c = max(0, m - step + 1)
            s = np.zeros(m + 1, np.int32)  # the last `step` positions are ends
            s[:c] = ranks[used : used + c] + 1
            used += c
            p = np.arange(m + 1, dtype=np.int32)
            symbol.append(s)
            after.append(base + np.where(s > 0, np.minimum(p + step, m), p))
            before.append(np.concatenate([np.zeros(min(step, m + 1), np.int32), s[: max(0, m + 1 - step)]]))
            text.append(np.full(m + 1, i, np.int32))
            position.append(p)
            base += m + 1
        shards.append(Transform(np.concatenate(symbol), np.concatenate(after), np.concatenate(before)))
        place.append((np.concatenate(text)[shards[-1].order], np.concatenate(position)[shards[-1].order]))
        first = last
    row, prefix = merge(shards, passes)
    same = prefix >= passes  # as the row before
    rows = row[same | np.append(same[1:], False)]
    text, position = np.concatenate([p[0] for p in place])[rows], np.concatenate([p[1] for p in place])[rows]
    out = [np.zeros(max(0, int(m) - length + 1), bool) for m in sizes]
    order = np.argsort(text, kind="stable")
    text, position = text[order], position[order]
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        out[i][position[cut[i] : cut[i + 1]]] = True
    return out


def ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


RUN = "h long, c1 long, c2 long, k1 long, k2 long, a int, r int, own boolean, once boolean"
RUN_KINDS = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.bool_()] * 2
RUN_NAMES = ["h", "c1", "c2", "k1", "k2", "a", "r", "own", "once"]


def table_of(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def runs_table(keyed: DataFrame, length: int) -> DataFrame:
    """Every run: its least hash, a digest of its bytes, its document's key, first window, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            data, offsets = strings(b.column(2))
            rows: list[tuple] = []
            for i, (k1, k2) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                text = data[offsets[i] : offsets[i + 1]]
                raw = text.tobytes()
                rows += [(h, *digest(raw[a : a + n + length - 1]), k1, k2, a, n, own, True) for h, a, n, own in cut_runs(text, length, int(length * SEED))]
                if len(rows) >= 20_000 or i == b.num_rows - 1 and rows:
                    yield table_of(rows, RUN_KINDS, RUN_NAMES)
                    rows = []

    return keyed.mapInArrow(run, RUN)


def cut_again(pieces: DataFrame, length: int, part: float) -> DataFrame:
    """The runs, with their bytes, of pieces by a longer part of the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k1, k2, at, once, raw in zip(*(c.to_pylist() for c in b.columns)):
                cuts = cut_runs(np.frombuffer(raw, np.uint8), length, int(length * part))
                rows += [(h, *digest(x := raw[a : a + n + length - 1]), k1, k2, at + a, n, own, once, x) for h, a, n, own in cuts]
                if len(rows) >= 5_000:
                    yield table_of(rows, [*RUN_KINDS, pa.binary()], [*RUN_NAMES, "bytes"])
                    rows = []
            if rows:
                yield table_of(rows, [*RUN_KINDS, pa.binary()], [*RUN_NAMES, "bytes"])

    return pieces.select("k1", "k2", "a", "once", "bytes").mapInArrow(run, RUN + ", bytes binary")


def held(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written: (k1, k2, lo, hi) of runs that occur with equal bytes elsewhere; and the distinct runs that are still to be searched.

    The latter are (h, k1, k2, a, r, once, crowd) and bytes if ``runs`` have them; crowd counts the distinct runs of a hash."""
    extra = [c for c in runs.columns if c == "bytes"]
    by_hash = runs.groupBy("h").agg(F.count("*").alias("n"), F.min("c1").alias("lo"), F.max("c1").alias("hi"), F.max("own").alias("any_own")).where("n > 1 or any_own").select("h", (F.col("lo") != F.col("hi")).alias("several"))
    by_hash = written(by_hash, "suffix-hashes")  # before the join, so that Spark can split a hash that many documents share
    shared = written(runs.join(by_hash, "h"), "suffix-shared")
    groups = shared.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "a", "r", *extra)).alias("at"), F.max("own").alias("own"), F.max("several").alias("several"), F.max("once").alias("once"))
    distinct = written(groups.select("h", "c1", "c2", "n", "at.*", "own", "several", "once"), "suffix-distinct")
    equal = shared.where("once").join(distinct.where("n > 1").select("h", "c1", "c2"), ["h", "c1", "c2"])
    whole = written(equal.select("k1", "k2", F.col("a").alias("lo"), F.expr("a + r").cast("int").alias("hi")), "suffix-whole")
    # Written, so that the join below deals both sides anew and can split a crowded hash.
    crowd = written(distinct.where("several").groupBy("h").agg(F.count("*").alias("crowd")), "suffix-crowd")
    left = distinct.where("several or (own and n = 1)").join(crowd, "h", "left")
    left = written(left.select("h", "k1", "k2", "a", "r", F.expr("once and n = 1").alias("once"), F.coalesce("crowd", F.lit(1)).alias("crowd"), *extra), "suffix-left")
    discard(shared, distinct, crowd, by_hash)
    return whole, left


def bytes_of(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Pieces (h, k1, k2, a, once, crowd, bytes): the wanted runs' bytes. A run that occurs once is of a row that occurs once."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "a", "r", "once", "crowd")).alias("runs"))  # of one text, so bounded by it
    choose = sifted(keyed, F.xxhash64("k1", "k2"), wanted.select(F.xxhash64("k1", "k2").alias("key")))
    joined = choose(True).join(lists, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
        names = ["h", "k1", "k2", "a", "once", "crowd", "bytes"]
        for b in batches:
            out: list[tuple] = []
            for i, (k1, k2) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                raw = b.column(2)[i].as_py() or b""
                out += [(x["h"], k1, k2, x["a"], x["once"], x["crowd"], raw[x["a"] : x["a"] + x["r"] + length - 1]) for x in b.column(3)[i].as_py()]
                if len(out) >= 5_000 or i == b.num_rows - 1 and out:
                    yield table_of(out, kinds, names)
                    out = []

    return joined.select("k1", "k2", F.col("text").cast("binary").alias("text"), "runs").mapInArrow(run, "h long, k1 long, k2 long, a int, once boolean, crowd long, bytes binary")


def search(pieces: DataFrame, length: int, step: int) -> DataFrame:
    """(k1, k2, lo, hi): windows of the pieces that occur once as a whole, but are repeated elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, out = 0, []

        def searched() -> None:
            texts = [np.frombuffer(g[5], np.uint8) for g in group]
            for g, marks in zip(group, repeated_windows(texts, length, step)):
                if g[4]:
                    out.extend((g[1], g[2], g[3] + lo, g[3] + hi) for lo, hi in ranges(marks))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= GROUP_BYTES and row[0] != group[-1][0]:
                    searched()
                    group, size = [], 0
                group.append(row)
                size += len(row[5])
            if len(out) > 10_000:
                yield table_of(out, kinds, names)
                out = []
        if group:
            searched()
        if out:
            yield table_of(out, kinds, names)

    kinds, names = [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["k1", "k2", "lo", "hi"]
    n = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.select("h", "k1", "k2", "a", "once", "bytes").repartition(n, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "k1 long, k2 long, lo int, hi int")


def repeated_spans(documents: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """k1, k2, spans array<struct<lo, hi>>, written: the repeated windows of each document that has some, keyed as by ``keyed_of``."""
    keyed = keyed_of(documents)
    runs = written(runs_table(keyed, length), "suffix-runs")
    whole, left = held(runs)
    discard(runs)
    pieces = written(bytes_of(keyed, left, length), "suffix-pieces")
    discard(left)
    spans, levels = [whole], [pieces]
    for most, part in SPLITS:
        crowded = levels[-1].where(F.col("crowd") >= most)
        if crowded.isEmpty():
            break
        runs = written(cut_again(crowded, length, part), "suffix-runs")
        whole, left = held(runs)
        discard(runs)
        spans.append(whole)
        levels.append(left)
    for at, level in enumerate(levels):
        # What the next level has taken over is searched there.
        spans.append(written(search(level.where(F.col("crowd") < SPLITS[at][0]) if at + 1 < len(levels) else level, length, step), "suffix-found"))
    all_spans = spans[0]
    for x in spans[1:]:
        all_spans = all_spans.unionByName(x)
    out = written(all_spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix-spans")  # of one text, so bounded by it
    discard(*levels, *spans)
    return out


def keyed_of(documents: DataFrame) -> DataFrame:
    """k1, k2, text: rows with the same key are of the same text, so that they share all results."""
    docs = documents_of(documents)
    return docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.length("text"), "doc_id").alias("k2"), "text")


def covered(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the windows cover."""
    out: list[list[int]] = []
    for s in sorted((x["lo"], x["hi"] + length - 1) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def without(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in cuts:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def text_without(data: bytes, cuts: list[tuple[int, int]]) -> str:
    """What is left as text. Each part is decoded on its own, so that halves of two cut characters do not make a third."""
    starts, ends = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(data)]
    return "".join(data[a:b].decode("utf-8", "ignore") for a, b in zip(starts, ends))


def removal_digest(documents: DataFrame, length: int = LENGTH, step: int = STEP, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; and ``with_text``, the text that is left, in which characters cut in part go as a whole."""
    spans = repeated_spans(documents, length, step)
    docs = documents_of(documents).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.length("text"), "doc_id")})
    choose = sifted(docs.select("doc_id", F.col("text").cast("binary").alias("text"), "k1", "k2"), F.xxhash64("k1", "k2"), spans.select(F.xxhash64("k1", "k2").alias("key")))
    joined = choose(True).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        names, kinds, schema = [*names, "text"], [*kinds, pa.string()], f"{schema}, text string"

    def digests(batches: Iterator[pa.RecordBatch], with_spans: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                data, cuts = b.column(1)[i].as_py() or b"", covered(b.column(2)[i].as_py(), length) if with_spans else []
                kept = without(data, cuts)
                out.append((doc_id, len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), *([text_without(data, cuts)] if with_text else [])))
                size += len(kept)
                if size >= OUT_BYTES or i == b.num_rows - 1:
                    yield table_of(out, kinds, names)
                    out, size = [], 0

    return joined.mapInArrow(lambda batches: digests(batches, True), schema).unionByName(choose(False, lambda batches: digests(batches, False), schema))


def remove_repeats(documents: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """The same rows and columns, without the repeated bytes of ``text``; characters cut in part go as a whole."""
    columns = documents.columns
    spans = repeated_spans(documents, length, step).select("k1", "k2", "spans")
    whole = F.coalesce(documents["text"], F.lit(""))
    key = F.struct(F.xxhash64(whole).alias("k1"), F.xxhash64(F.length(whole), documents["doc_id"].cast("long")).alias("k2"))
    # The rows go as one struct, so that no column's name can clash.
    rows = documents.select(key.alias("key"), F.struct(*[F.col(c) for c in columns]).alias("row"))
    choose = sifted(rows, F.xxhash64("key.k1", "key.k2"), spans.select(F.xxhash64("k1", "k2").alias("key")))
    joined = choose(True).join(spans, (F.col("key.k1") == F.col("k1")) & (F.col("key.k2") == F.col("k2")), "left").select("row.*", "spans")
    at, last = columns.index("text"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(at).to_pylist(), b.column(last).to_pylist()
            clean = [t if t is None or not s else without(t.encode(), covered(s, length)).decode("utf-8", "ignore") for t, s in zip(texts, spans)]
            arrays = [pa.array(clean, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns[:last])]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.mapInArrow(run, documents.schema).unionByName(choose(False).select("row.*"))
