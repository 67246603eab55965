"""Runs of repeating words, by a suffix automaton with merged end-position sets.

A run is a stretch of consecutive words with smallest period q, of ``least`` words and two periods at least, that
no neighbouring word extends. A text's suffix automaton has one state for each class of word sequences that end
at the same places. States hand their end positions, kept in order, up their suffix links from the longest to
the shortest, the smaller set into the larger. Two ends that first become neighbours in a state are the last two
places of the state's longest sequence, which is as far back as both places agree; if their distance q is no
more than the state's length they seed a square of period q. That seed reaches as far left as the run does; of the seeds
of one run the one that no next word extends is the run itself, with the least q, as no end lies between.

In a run of length L the words agree at distance q over L - q words, at least half of ``least``, so that each of its words
lies in a sequence of that many words that occurs twice. Stretches without are cut out beforehand, again and
again until nothing goes, and automata are built of what is left; sequences shorter than that hand nothing on.

Defined cases: null, empty and wordless texts have no run; a text shorter than ``least`` has none; rows that
repeat are rows of their own; a null identifier is left as it is by ``every_tenth``; an empty table gives an empty
result; columns other than doc_id and text are never read. Texts of any length are read whole, one at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents_of, let_go

_MULT = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """The suffix automaton of a sequence of numbers; state 0 is the empty one."""

    def __init__(self, words: list[int]):
        follow, link, length, end = [{}], [-1], [0], [-1]
        last = 0
        for place, word in enumerate(words):
            new = len(link)
            follow.append({})
            length.append(place + 1)
            link.append(0)
            end.append(place)  # where the sequence that made the state ends; -1 for copies
            at = last
            while at >= 0 and word not in follow[at]:
                follow[at][word] = new
                at = link[at]
            if at >= 0:
                old = follow[at][word]
                if length[old] > length[at] + 1:
                    copy = len(link)
                    follow.append(follow[old].copy())
                    length.append(length[at] + 1)
                    link.append(link[old])
                    end.append(-1)
                    while at >= 0 and follow[at].get(word) == old:
                        follow[at][word] = copy
                        at = link[at]
                    link[old] = old = copy
                link[new] = old
            last = new
        self.link, self.length, self.end = link, length, end


def runs_of(words: list[int], least: int = 12) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs."""
    found: set[tuple[int, int, int]] = set()
    n = len(words)
    if n < least:
        return found
    a = Automaton(words)
    shortest = -(-least // 2)
    # End positions are kept negated, in ascending order: a state's own is its first and so goes to the end.
    sets: dict[int, list[list[int]]] = {}
    for state in sorted((s for s in range(1, len(a.link)) if a.length[s] >= shortest), key=a.length.__getitem__, reverse=True):
        parts = sets.pop(state, [])
        if a.end[state] >= 0:
            parts.append([-a.end[state]])
        whole = max(parts, key=len)
        came = [x for part in parts if part is not whole for x in part]
        for x in came:
            insort(whole, x)
        size = a.length[state]
        for x in came:
            at = bisect_left(whole, x)
            for near in whole[max(0, at - 1) : at] + whole[at + 1 : at + 2]:
                first, second = (-x, -near) if x > near else (-near, -x)
                period = second - first
                start = first - size + 1
                if period > size or period + size < least:
                    continue
                if second + 1 < n and words[second + 1] == words[first + 1]:
                    continue  # the seed of an end before the run's last
                if start and words[start - 1] == words[start - 1 + period]:
                    continue  # neighbours since a longer sequence
                found.add((start, period + size, period))
        if (up := a.link[state]) > 0 and a.length[up] >= shortest:
            sets.setdefault(up, []).append(whole)
    return found


def stretches(words: np.ndarray, least: int = 12) -> list[tuple[int, int]]:
    """Parts (start, end) that hold all runs: each word in a sequence of half of ``least`` that occurs twice in its part."""
    size = -(-least // 2)
    parts = [(0, len(words))] if len(words) >= least else []
    while parts:
        left = sum(j - i for i, j in parts)
        start = np.concatenate([np.arange(i, j - size + 1) for i, j in parts])
        key = np.repeat(np.arange(len(parts), dtype=np.uint64), [j - i - size + 1 for i, j in parts])
        for k in range(size):
            key = key * _MULT + words[start + k].astype(np.uint64)  # equal sequences have equal keys; equal keys may differ, which only keeps more
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        some = start[count[inverse] > 1]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, some, 1)
        np.add.at(edge, some + size, -1)
        held = np.cumsum(edge)[:-1] > 0
        first = held.copy()
        first[1:] &= ~held[:-1]
        border = np.array([i for i, _ in parts])
        first[border] = held[border]  # parts that touch stay apart: no run lies across
        start = np.flatnonzero(first)
        end = start + np.bincount(np.cumsum(first)[held], minlength=len(start) + 1)[1:]
        parts = [(i, j) for i, j in zip(start.tolist(), end.tolist()) if j - i >= least]
        if sum(j - i for i, j in parts) == left:
            break
    return parts


def runs_in(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs, by start, then period."""
    if len(words) < least:
        return []
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = []
    for i, j in stretches(numbers, least):
        found += [(i + start, length, period) for start, length, period in runs_of(numbers[i:j].tolist(), least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that some run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def every_tenth(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: one text in ten, by the checksum of its identifier, repeats from some word on with some period."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def as_it_is(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def periodic_runs(documents: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] = as_it_is, least: int = 12) -> DataFrame:
    """doc_id, text, runs of every row: its words as ``change`` leaves them, without those that runs repeat, and its runs."""
    schema = "doc_id long, text string, runs array<struct<start:long,length:long,period:long>>"
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        runs = [[dict(zip(("start", "length", "period"), r)) for r in found] for _, _, _, found in rows]
        texts = [b" ".join(kept).decode() for _, _, kept, _ in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(texts, pa.string()), pa.array(runs, pa.list_(run_type))], ["doc_id", "text", "runs"])

    return _over_texts(documents, change, least, out, schema)


def run_digest(documents: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] = every_tenth, least: int = 12) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the text without what they repeat."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = []
        for doc_id, _, kept, runs in rows:
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
            exponent = None if best is None else 1000 * best[1] // best[2]
            told = "".join("%d,%d,%d\n" % r for r in runs).encode()
            columns.append((doc_id, len(runs), *(best or (None, None, None)), exponent, hashlib.sha256(told).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, zip(*columns))], names)

    return _over_texts(documents, change, least, out, ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names))


def _over_texts(documents: DataFrame, change: Callable, least: int, out: Callable[[list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = change(doc_id, text.as_buffer().to_pybytes().split())  # at blanks and the characters 9 to 13, as the word rule says
                runs = runs_in(words, least)
                rows.append((doc_id, words, collapsed(words, runs), runs))
                size += len(words)
                if size >= 1 << 17:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    return documents_of(documents).mapInArrow(run, schema)
