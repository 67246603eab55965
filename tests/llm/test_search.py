"""Ranked lexical search, exact inner products and runs of words, against brute force and on odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from engram.llm import impact, lexical, periodic
from tests.llm.test_operators import docs, empty, rows_of  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked lexical search ---


def ranked(rows, items, k):
    texts = [(i, TERM.findall(t.translate(LOWER))) for i, t in rows]
    texts = [(i, Counter(t), len(t)) for i, t in texts if t]
    n, total = len(texts), sum(x[2] for x in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, tf, size in texts:
            m = 100 - 25 + (25 * size * n) // total
            score = 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def test_lexical_search(spark, docs, empty):  # noqa: F811
    rows = rows_of(docs)
    texts = [t for _, t in rows if t]
    some = [(i, " ".join(random.Random(i).sample(texts[i % len(texts)].split() or ["x"], min(12, len(texts[i % len(texts)].split()) or 1)))) for i in range(40)]
    some += [(100, None), (101, ""), (102, "zzzz nothing-of-this"), (103, "same same same"), (103, "other"), (None, "same")]
    items = spark.createDataFrame(some, "item_id long, text string").withColumn("score", F.lit("clash"))
    got = lexical.lexical_search(docs, items, k=7)
    assert Counter(tuple(r) for r in got.collect()) == ranked(rows, some, 7)
    # Many shards, many blocks of items: the same.
    assert Counter(tuple(r) for r in lexical.lexical_search(docs, items, 7, shard_bytes=2000, block_bytes=300).collect()) == ranked(rows, some, 7)
    assert lexical.lexical_search(empty, items).count() == 0 and lexical.lexical_search(docs, items.limit(0)).count() == 0
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_lexical_ties(spark):
    """Many equal documents: the least identifiers win, whatever shard they are in."""
    rows = [(i, "alpha beta") for i in range(300, 0, -1)] + [(i, "gamma") for i in range(1000, 1400)] + [(None, "alpha beta")]
    got = lexical.lexical_search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "beta")], "item_id long, text string"), shard_bytes=200).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 21)) and len({r.score for r in got}) == 1


def test_compressed_postings():
    rng = np.random.default_rng(3)
    lists = [np.sort(rng.choice(2**k, min(2**k, 40), replace=False)) for k in (1, 4, 9, 17, 30, 40)] + [np.array([0])]
    tf = [rng.integers(1, 2 ** rng.integers(1, 34), len(x)) for x in lists]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    for (a, b), x, y in zip(map(lexical.expand, lexical.compressed(np.concatenate(lists), np.concatenate(tf), at)), lists, tf):
        assert a.tolist() == x.tolist() and b.tolist() == y.tolist()


def test_heap_prunes_nothing():
    rng = random.Random(4)
    for _ in range(200):
        n, k = rng.randrange(1, 60), rng.randrange(1, 8)
        lists = []
        for _ in range(rng.randrange(1, 7)):
            ords = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
            p = object.__new__(lexical.Postings)
            p.ords, p.scores = ords, [rng.choice([0, 1, 1, 2, 5]) * rng.choice([1, 30]) for _ in ords]
            p.most = max(p.scores)
            lists.append((p, rng.randrange(1, 3)))
        total = Counter()
        for p, times in lists:
            for o, s in zip(p.ords, p.scores):
                total[o] += s * times
        found = []
        lexical.merge_heap(lists, [(0, -i) for i in range(n)], found, k)
        assert sorted((-s, -i) for s, _, i in found) == sorted((-s, o) for o, s in total.items() if s > 0)[:k]


# --- exact inner products ---


def products(rows, every, k):
    units = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    queries = {}
    for i, u in units:
        if i % every == 0:
            queries[i] = min(u, queries.get(i, u))
    out = []
    for q, u in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in units if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return Counter(out)


def test_top_products(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 30])).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(60)]  # repeated vectors: ties
    rows += [(500, [0.0] * 6), (40, rows[3][1]), (60, rows[60][1]), (7, rows[8][1]), (-20, [1.0] * 6), (620, [-0.01, 0.01, 0.0, 0.0, 0.0, 0.0])]
    odd = [(700, None), (720, []), (740, [1.0, 2.0]), (760, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (780, [float("nan")] + [0.0] * 5), (800, [float("inf")] + [0.0] * 5), (820, [1e300] + [0.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"score": F.lit("clash"), "units": F.lit(1), "shard": F.lit(0)})
    want = products(rows, 20, 20)
    assert Counter(tuple(r) for r in impact.top_products(df).collect()) == want
    assert Counter(tuple(r) for r in impact.top_products(df, shard_rows=50, group_queries=3).collect()) == want
    few = df.where("vec_id in (20, 21, 22)")
    assert impact.top_products(few).count() == 2 and impact.top_products(df.limit(0)).count() == 0 and impact.top_products(df.where("vec_id = 20")).count() == 0


def test_shard_walks():
    """Both ways of finding places in lists, wide and narrow values, and ties at the end."""
    rng = np.random.default_rng(6)
    for scale, n in ((3, 500), (40, 2000), (1 << 26, 300), (1, 90)):
        units = rng.integers(-scale, scale + 1, (n, 9))
        order = np.argsort(units.T, 1, kind="stable")
        shard = impact.Shard(np.arange(n) * 3, order.astype("<u2"), np.take_along_axis(units.T, order, 1))
        assert (shard.units == units).all()
        some = np.arange(0, n, 37)
        for floor in (impact.NONE, 0, 2 * scale * scale):
            place, ids, scores = shard.best(units[some], some * 3, 20, np.full(len(some), floor))
            for p, i in enumerate(some.tolist()):
                want = sorted((-int(s), j * 3) for j, s in enumerate(units @ units[i]) if j != i and s >= floor)[:20]
                assert [(-s, j) for s, j in zip(scores[place == p].tolist(), ids[place == p].tolist())] == want
        bound = rng.integers(-scale - 5, scale + 5, 9)
        assert shard.place(bound).tolist() == [int((units[:, d] < b).sum()) for d, b in enumerate(bound)]
        shard.wide = True
        assert shard.place(bound).tolist() == [int((units[:, d] < b).sum()) for d, b in enumerate(bound)]


# --- runs of words ---


def plain_runs(w, least):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_words():
    rnd = random.Random(7)
    for _ in range(1500):
        k, n = rnd.choice([1, 2, 2, 3, 4, 6]), rnd.randrange(70)
        w = [b"%d" % rnd.randrange(k) for _ in range(n)]
        if rnd.random() < 0.5:
            w = w[: rnd.randrange(20)] + [b"%d" % rnd.randrange(k) for _ in range(rnd.randrange(1, 9))] * rnd.randrange(2, 8) + w[20:]
        least = rnd.choice([12, 12, 4, 2, 5, 7])
        want = plain_runs(w, least)
        assert periodic.runs_in(w, least) == want
        assert sorted(periodic.runs_of([int(x) for x in w], least), key=lambda r: (r[0], r[2])) == want
    assert periodic.runs_in([b"a"] * 50_000) == [(0, 50_000, 1)]


def test_run_digest(spark, docs, empty):  # noqa: F811
    want = Counter()
    more = spark.createDataFrame([(3000 + i, ("one two three four five six seven " * 4 + "x y ") * (i + 1)) for i in range(30)], "doc_id long, text string")
    table = docs.unionByName(more, allowMissingColumns=True)
    changed = 0
    for i, text in rows_of(table):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)], changed + 1
        runs = plain_runs(words, 12) if n < 1500 else periodic.runs_in(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        drop = {j for s, size, q in runs for j in range(s + q, s + size)}
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        kept = b" ".join(x for j, x in enumerate(words) if j not in drop)
        want[(i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())] += 1
    assert changed > 3
    assert Counter(tuple(r) for r in periodic.run_digest(table).collect()) == want
    assert periodic.run_digest(empty).count() == 0
    own = {r.doc_id: r for r in periodic.periodic_runs(more).collect()}
    assert own[3000].text == "one two three four five six seven x y" and [tuple(x) for x in own[3000].runs] == [(0, 28, 7)]
