"""Local moves that raise modularity, on arrays: whole bounded graphs in one task, or the best moves of each node where edges lie in many tasks.

After Blondel and others, 2008. A graph is of pairs (a, b, w) of node numbers, a <> b, each once, and strengths k, which count a node's inner edges twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The least gain that counts, and differences that count as ties, as parts of the total weight.
LEAST, TIE = 1e-9, 1e-12


def best_of(now: int, k: float, places: np.ndarray, w: np.ndarray, sigma: np.ndarray, total: float) -> tuple[int, float, float, float]:
    """A node's best community of those linked (ties: the lesser), its gain there and where it is, and its links inside the latter. places: its neighbours' communities."""
    if len(places) * 16 > len(sigma):
        inside = np.bincount(places, w, len(sigma))
        found = np.flatnonzero(inside)
        inside = inside[found]
    else:
        found, at = np.unique(places, return_inverse=True)
        inside = np.bincount(at, w)
    gain = inside - sigma[found] * (k / (2 * total))
    own, stay = 0.0, -k * (sigma[now] - k) / (2 * total)
    i = int(np.searchsorted(found, now))
    if i < len(found) and found[i] == now:
        own = float(inside[i])
        stay += own
        gain[i] = stay
    top = gain.max() if len(gain) else -np.inf
    best = int(found[int((gain >= top - TIE * total).argmax())]) if len(gain) else now
    return best, float(top), float(stay), own


def swept(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, total: float, rounds: int | None) -> tuple[np.ndarray, bool]:
    """The community of each node once no move of one gains (or after ``rounds`` sweeps), and whether any moved. Nodes move in order, one after the other.

    After the first sweep only neighbours of nodes that moved are looked at; when none is left, all are, until that moves none."""
    n = len(k)
    u, v = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(u.astype(np.int64) * n + v, kind="stable")
    v, w = v[order], np.concatenate([w, w])[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))])
    del u, order
    label, active, made, ever = np.arange(n), np.ones(n, bool), 0, False
    while rounds is None or made < rounds:
        sigma, todo, moved = np.bincount(label, k, n), np.flatnonzero(active), False
        whole = len(todo) == n
        active[:] = False
        for x in todo:
            near = v[start[x] : start[x + 1]]
            now = label[x]
            best, top, stay, _ = best_of(now, k[x], label[near], w[start[x] : start[x + 1]], sigma, total)
            if best != now and top > stay + LEAST * total:
                sigma[now] -= k[x]
                sigma[best] += k[x]
                label[x] = best
                active[near] = moved = True
        made, ever = made + 1, ever or moved
        if not moved:
            if whole:
                break
            active[:] = True
    return label, ever


def settled(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, total: float, rounds: int | None = None) -> np.ndarray:
    """The community of each node when no move gains any more, neither of nodes nor, level by level, of communities."""
    member = np.arange(len(k))
    while True:
        label, moved = swept(a, b, w, k, total, rounds)
        if not moved:
            return member
        label = np.unique(label, return_inverse=True)[1]
        member, k = label[member], np.bincount(label, k)
        a, b = label[a], label[b]
        apart = a != b
        key, at = np.unique(np.minimum(a, b)[apart] * len(k) + np.maximum(a, b)[apart], return_inverse=True)
        a, b, w = key // len(k), key % len(k), np.bincount(at, w[apart], len(key))


def settle_rows(total: float, rounds: int | None):
    """For mapInArrow over one partition of (a, b, w), a row (node, node, k) for each node: (node, community) by identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        a, b, w = (np.concatenate(x) for x in zip(*parts))
        del parts
        own = a == b
        order = np.argsort(a[own])
        ids, k = a[own][order], w[own][order]
        place = lambda x: np.searchsorted(ids, x[~own]).astype(np.int32)
        label = settled(place(a), place(b), w[~own], k, total, rounds)
        first = np.full(label.max() + 1, len(ids))
        np.minimum.at(first, label, np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[first[label]])], ["node", "community"])

    return run


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, w) sorted by a, as (a, near, w): each node's neighbours and weights as one row of bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    node = None

    def row(x):
        return [x, np.concatenate([h[0] for h in held]).tobytes(), np.concatenate([h[1] for h in held]).tobytes()]

    def made(rows):
        x, near, w = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(near, pa.binary()), pa.array(w, pa.binary())], ["a", "near", "w"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, w = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype("<i4"), batch.column(2).to_numpy().astype("<f8")
        ends = np.flatnonzero(np.diff(a)) + 1
        out = []
        for i, j in zip(np.concatenate([[0], ends]), np.concatenate([ends, [len(a)]])):
            if node is not None and a[i] != node:
                out.append(row(node))
                held.clear()
            node = a[i]
            held.append((b[i:j], w[i:j]))
        if out:
            yield made(out)
    if node is not None:
        yield made([row(node)])


def proposing_rows(state, total: float):
    """For mapInArrow over packed rows: (node, best, gain, stay, inside) of each node under the shared (label, sigma, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, sigma, k = state.value
        for batch in batches:
            nodes, out = batch.column(0).to_numpy(), []
            for x, near, w in zip(nodes, batch.column(1), batch.column(2)):
                out.append(best_of(label[x], k[x], label[np.frombuffer(near.as_buffer(), "<i4")], np.frombuffer(w.as_buffer(), "<f8"), sigma, total))
            if out:
                best, gain, stay, inside = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(best, pa.int32()), pa.array(gain, pa.float64()), pa.array(stay, pa.float64()), pa.array(inside, pa.float64())], ["node", "best", "gain", "stay", "inside"])

    return run


def moved_by(propose, k: np.ndarray, total: float, rounds: int | None) -> np.ndarray | None:
    """The community of each node when none gains any more, or None where none gains from the start. ``propose`` tells (best, gain, stay, inside) of all nodes under (label, sigma).

    Many nodes move at once: in each round all of a share; should that not raise modularity, fewer, and at last only
    moves no two of which touch one community, whose gains add up."""
    n = len(k)

    def weighed(label: np.ndarray):
        sigma = np.bincount(label, k, n)
        best, gain, stay, inside = propose(label, sigma)
        return label, best, gain - stay, (best != label) & (gain > stay + LEAST * total), float((inside - k * sigma[label] / (2 * total)).sum())

    def apart(label: np.ndarray, best: np.ndarray, more: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """The moves that gain most in both communities that they touch."""
        x = np.flatnonzero(moves)
        x = x[np.lexsort((x, -more[x]))]
        first = np.full(n, len(x))
        for side in (label[x], best[x]):
            np.minimum.at(first, side, np.arange(len(x)))
        chosen = np.zeros(n, bool)
        chosen[x[(first[label[x]] == np.arange(len(x))) & (first[best[x]] == np.arange(len(x)))]] = True
        return chosen

    label, best, more, moves, q = weighed(np.arange(n, dtype=np.int32))
    if not moves.any():
        return None
    made = tries = 0
    while moves.any() and (rounds is None or made < rounds):
        for share in (2, 8, None):
            tries += 1
            mixed = (np.arange(n, dtype=np.uint64) + np.uint64(tries << 32)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            go = apart(label, best, more, moves) if share is None else moves & ((mixed >> np.uint64(40)) % np.uint64(share) == 0)
            after = weighed(np.where(go, best, label).astype(np.int32))
            if after[4] > q:
                break
        else:  # what is left to gain is lost in rounding
            break
        (label, best, more, moves, q), made = after, made + 1
    return label
