"""Communities with the queries' own defaults: no move of a node and no merge of two communities raises modularity."""

import itertools
import random

import numpy as np

from engram.operators import graph, ingest, louvain

SCHEMA = "id long, source_id long, target_id long, relationship_type string, confidence double, valid boolean"


def found(spark, edges):
    r = spark.createDataFrame([(i, a, b, "uses", 1.0, True) for i, (a, b) in enumerate(edges)], SCHEMA)
    return {x.node: x.community for x in graph.communities(r, least=1).collect()}


def modularity(edges, label):
    m, inside, degree = len(edges), 0, {}
    for a, b in edges:
        inside += label[a] == label[b]
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0) + 1
    return inside / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def no_merge_gains(edges, label):
    q = modularity(edges, label)
    pairs = {tuple(sorted((label[a], label[b]))) for a, b in edges if label[a] != label[b]}
    return all(modularity(edges, {n: a if c == b else c for n, c in label.items()}) <= q + 1e-9 for a, b in pairs)


def test_ring_of_cliques_is_contracted(spark):
    n, size = 24, 4
    edges = [(c * size + a, c * size + b) for c in range(n) for a, b in itertools.combinations(range(size), 2)]
    edges += [(c * size, (c + 1) % n * size + 1) for c in range(n)]
    label = found(spark, edges)
    assert all(len({label[c * size + i] for i in range(size)}) == 1 for c in range(n))
    single = {x: x // size for x in range(n * size)}
    assert modularity(edges, label) > modularity(edges, single) and no_merge_gains(edges, label)


def test_nobody_is_left_over(spark):
    rng = random.Random(3)
    group = {x: x // 60 for x in range(240)}
    edges = sorted({(a, b) for a, b in itertools.combinations(range(240), 2) if rng.random() < (0.3 if group[a] == group[b] else 0.005)})
    label = found(spark, edges)
    assert len(set(label.values())) == 4 and all(len({label[x] for x in range(240) if group[x] == g}) == 1 for g in range(4))


def merged_plainly(groups, edges, least):
    """One small community after the other."""
    order = sorted(groups, key=lambda c: (-len(groups[c]), c))
    majors = [c for c in order if len(groups[c]) >= least]
    if not majors:
        return {n: c for c, ns in groups.items() for n in ns}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    where = {n: c for c in majors for n in groups[c]}
    orphans, out = [], {}
    for c in order:
        if c in majors:
            continue
        count = {}
        for n in groups[c]:
            for v in near.get(n, ()):
                if v in where:
                    count[where[v]] = count.get(where[v], 0) + 1
        if count:
            best = min(count, key=lambda r: (-count[r], r))
            where |= {n: best for n in groups[c]}
        else:
            orphans.append(c)
    out = dict(where)
    open_, held = [], 0
    for c in orphans + [None]:
        if c is not None:
            open_.append(c)
            held += len(groups[c])
        if open_ and (c is None or held >= least):
            out |= {n: min(open_) for x in open_ for n in groups[x]}
            open_, held = [], 0
    return out


def test_small_communities_join_in_order(spark):
    rng = random.Random(11)
    for case in range(5):
        groups, n = {}, 0
        for c in range(60):
            size = rng.choice([1, 1, 1, 2, 2, 3, 4, 5, 6, 9] + ([12] if case else []))
            groups[c * 3 % 61] = list(range(n, n + size))
            n += size
        edges = {tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(n // (1 + case % 3))}
        edges |= {(x, x + 1) for x in range(0, n - 1, 3)} if case == 4 else set()
        members = spark.createDataFrame([(x, c) for c, xs in groups.items() for x in xs], "node long, community long")
        links = spark.createDataFrame(sorted(e for e in edges if e[0] != e[1]), "a long, b long")
        got = {r.node: r.community for r in ingest.merged_communities(members, links, 7).collect()}
        assert got == merged_plainly(groups, [e for e in edges if e[0] != e[1]], 7)
    alone = spark.createDataFrame([(1, 1), (2, 2)], "node long, community long")
    assert {tuple(r) for r in ingest.merged_communities(alone, links, 7).collect()} == {(1, 1), (2, 2)}


def test_rounds_over_labels_and_joins_settle_too(spark, monkeypatch):
    """The ways of larger graphs: by labels in the tasks, and with more nodes than those hold by joins."""
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(0, 900, 9), 2))) for _ in range(1500)})
    here = modularity(edges, found(spark, edges))
    monkeypatch.setattr(graph, "PAIRS", 0)
    label = found(spark, edges)
    assert no_merge_gains(edges, label) and abs(modularity(edges, label) - here) < 0.05
    monkeypatch.setattr(graph, "LABELS", 10)
    edges = [(c * 4 + a, c * 4 + b) for c in range(4) for a, b in itertools.combinations(range(4), 2)] + [(0, 4), (8, 12), (1, 8)]
    label = found(spark, edges)
    assert no_merge_gains(edges, label) and all(len({label[c * 4 + i] for i in range(4)}) == 1 for c in range(4))


def test_no_move_of_a_node_gains():
    """A dense random graph, whose many small gains took very many rounds of joins."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 200, (2, 12_000))
    w, n = np.ones(len(a)), 200
    a, b, w = a[a != b], b[a != b], w[a != b]
    k, total = np.bincount(a, w, n) + np.bincount(b, w, n), float(len(a))
    label, moved = louvain.swept(a, b, w, k, total, None)
    sigma = np.bincount(label, k, n)
    assert moved
    for x in range(n):
        near = np.concatenate([label[b[a == x]], label[a[b == x]]])
        best, gain, stay, _ = louvain.best_of(label[x], k[x], near, np.ones(len(near)), sigma, total)
        assert gain <= stay + 1e-6


def test_dense_tables_take_few_jobs(spark):
    """A round of joins was several jobs, and dense graphs take very many rounds: here each way has a bounded number of jobs."""
    n = 120
    edges = sorted({(a, b) for a, b in itertools.combinations(range(n), 2) if (a * 7 + b * 13) % 5})
    spark.sparkContext.setJobGroup("dense", "dense")
    label = found(spark, edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("dense"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(label) == n and no_merge_gains(edges, label) and jobs < 60
