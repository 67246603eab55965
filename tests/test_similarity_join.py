"""The pruned similarity join against all pairs: exact, with fewer copies where vectors gather; co-occurrences of crowded memories."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions.lineage import cut_one_by_one
from engram.operators import jobs, joins
from engram.operators.similarity_join import Plan, similar_pairs


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")


def brute(x, least, most=2.0):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    return {(i, j): s[i, j] for i, j in zip(*np.nonzero((s > least) & (s < most))) if i < j}


@pytest.mark.parametrize("least, most", [(0.9, 2.0), (0.5, 0.8), (-0.2, 2.0)])
def test_same_pairs(spark, least, most):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 10))
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 10)) * 0.2, rng.normal(size=(100, 10)), np.tile(centres[:1], (90, 1))])
    want = brute(x, least, most)
    for block in (40, 150, 4096):
        got = similar_pairs(frame(spark, x), least, most, block=block).collect()
        assert len(got) == len({(r.a, r.b) for r in got})
        edge = {p for p, s in want.items() if min(abs(s - least), abs(s - most)) < 1e-9}
        assert {(r.a, r.b) for r in got} - edge == set(want) - edge
        assert all(abs(want.get((r.a, r.b), r.similarity) - r.similarity) < 1e-9 for r in got)


def test_fewer_copies(spark):
    """Gathered vectors: far fewer rows are sent to products than rows times blocks; with nothing to rule out, no more than those."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 16))
    x = centres[rng.integers(0, 25, 2500)] + rng.normal(size=(2500, 16)) * 0.05
    n = len(x) // 100
    near, all_ = Plan(frame(spark, x), 0.95, 100), Plan(frame(spark, rng.normal(size=(2500, 16))), 0.2, 100)
    assert near.residents.sum() == 2500 and near.copies < len(x) * n / 4
    assert (all_.visitors <= 2500).all() and all_.visitors.sum() <= len(x) * n


def test_checked_pairs(spark):
    x = np.random.default_rng(3).normal(size=(60, 6))
    want = set(brute(x, 0.3))
    checked = sorted(want)[::3]
    df = spark.createDataFrame([(b, a) if n % 2 else (a, b) for n, (a, b) in enumerate((int(a), int(b)) for a, b in checked)], "a long, b long")
    assert {(r.a, r.b) for r in similar_pairs(frame(spark, x), 0.3, checked=df).collect()} == want - set(checked)


def test_cooccurrences_of_crowded_memories(spark):
    rng = np.random.default_rng(4)
    links = {(m, int(e)) for m in range(30) for e in rng.integers(0, 40, 12)} | {(m, e) for m in (100, 101) for e in range(40)}
    df = spark.createDataFrame(sorted(links), "memory_id long, entity_id long")
    by = {}
    for m in {m for m, _ in links}:
        for p in itertools.combinations(sorted(e for x, e in links if x == m), 2):
            by.setdefault(p, []).append(m)
    want = {(*p, len(m), tuple(sorted(m)[:3])) for p, m in by.items() if len(m) >= 4}
    for block in (5, 512):
        assert {(r.e1, r.e2, r.shared, tuple(r.sample)) for r in joins.cooccurrences(df.unionByName(df.limit(5)), 4, block=block).collect()} == want


def named(spark):
    """(id, name, type, mentions): a crowded name, small ones, and nulls."""
    rng = np.random.default_rng(4)
    rows = [(i, "crowd" if i % 3 else f"n{i % 60}", f"t{rng.integers(4)}", int(rng.integers(1, 9))) for i in range(300)]
    rows += [(300, None, "t1", 3), (301, "crowd", None, 3), (302, "crowd", "t1", None), (303, "lone", "t1", 9)]
    want = {(p[0], q[0]): (p[1], None if None in (p[3], q[3]) else p[3] + q[3]) for p, q in itertools.combinations(rows, 2) if p[1] and p[1] == q[1] and p[2] and q[2] and p[2] != q[2]}
    return spark.createDataFrame(rows, "id long, canonical_name string, entity_type string, mention_count long"), want


def test_crowded_names_are_many_tasks(spark):
    entities, want = named(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for block in (10, 64, 4096):
            pairs = joins.same_name_pairs(entities, block)
            got = pairs.collect()
            assert len(got) == len(want) and {(r.a, r.b): (r.name, r.mentions) for r in got} == want
        crowd = joins.same_name_pairs(entities, 10).where("name = 'crowd'").groupBy(F.spark_partition_id()).count().collect()
        assert len(crowd) == 4 and max(r["count"] for r in crowd) < 0.5 * sum(r["count"] for r in crowd)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_best_pairs_without_the_others(spark):
    entities, want = named(spark)
    order = lambda pairs: sorted(pairs, key=lambda p: (want[p][1] is None, -(want[p][1] or 0), p))
    free = order([p for p in want if sum(p) % 5])
    like = spark.createDataFrame([(1, 2, 0.9), (0, 999, 0.8), (3, 1, 0.7), (1, 3, 0.7), *[(*p, 0.99) for p in free[:3]]], "a long, b long, similarity double")
    for k, first in ((5, 2), (40, 3), (len(free), 64), (len(free) + 9, 64)):
        got = joins.best_same_name_pairs(entities, k, (F.col("a") + F.col("b")) % 5 != 0, first).orderBy(F.desc("mentions"), "a", "b").collect()
        assert [(r.a, r.b) for r in got] == free[:k]
    never = lambda: pytest.fail("similar pairs are not needed")
    checked = (F.col("a") + F.col("b")) % 5 == 0
    assert [(r.a, r.b, r.strategy) for r in jobs.duplicate_entities(entities, never, checked, 30).collect()] == [(*p, 1) for p in free[:30]]
    more = jobs.duplicate_entities(entities, lambda: like, checked, len(free) + 9).collect()
    rest = [p for p in ((1, 2), (0, 999), (1, 3), (3, 1)) if p not in want and sum(p) % 5]
    assert [(r.a, r.b, r.strategy) for r in more] == [(*p, 1) for p in free] + [(*p, 2) for p in rest]


def test_texts_come_to_pairs_in_slices(spark):
    """The verdicts are the same in one slice and in many, and no slice's plan sees all pairs."""
    n, seen = 40, []
    memories = spark.createDataFrame([(i, f"text {i} " * 300) for i in range(n)], "id long, content string")
    pairs = spark.createDataFrame([(a, b, ((a * 7 + b * 13) % 50) / 50 + a / 1e4 + b / 1e6) for a, b in itertools.combinations(range(n), 2)], "a long, b long, similarity double")

    def judge(df):
        seen.append(df.count())
        return df.withColumn("should_merge", F.when(F.col("a") % 9 != 0, F.col("similarity") >= 0.5)).withColumn("merged_content", F.concat(F.left("content_a", F.lit(9)), F.left("content_b", F.lit(9))))

    one, many = (jobs.consolidated(pairs, memories, judge, most) for most in (10_000, 100))
    for name in ("patch", "checked"):
        got = [sorted(map(tuple, x[name].collect()), key=repr) for x in (one, many)]
        assert got[0] == got[1] and len(got[0]) > 20
    assert seen[0] == sum(seen[1:]) == 780 and len(seen) == 9 and max(seen[1:]) < 200


def test_cooccurrences_in_slices(spark, monkeypatch):
    """Slices hold each pair once, of crowded memories too, and several are made where pairs are many."""
    rng = np.random.default_rng(6)
    rows = sorted({(int(m), int(e)) for m, e in zip(rng.integers(0, 6, 260), rng.integers(0, 45, 260))})
    links, slices = spark.createDataFrame(rows, "memory_id long, entity_id long"), []
    monkeypatch.setattr(joins, "cut_one_by_one", lambda made, n, name: slices.append(n) or cut_one_by_one(made, n, name))
    want = {}
    for m in range(6):
        for pair in itertools.combinations([e for x, e in rows if x == m], 2):
            want.setdefault(pair, []).append(m)
    want = {p: (len(ms), ms[:2]) for p, ms in want.items() if len(ms) >= 3}
    got = joins.cooccurrences(links, 3, sample=2, block=9, most=1).collect()
    assert len(got) == len(want) > 50 and {(r.e1, r.e2): (r.shared, r.sample) for r in got} == want and slices[0] > 3
