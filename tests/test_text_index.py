"""The inverted index against a plain version of its rules: words, phrases, alternatives, bans, stems, ranks, changes."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from engram.functions.stems import STOP_WORDS, stem
from engram.operators.text_index import TextIndex, parsed


def places(text):
    out = {}
    for i, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower()), 1):
        if w not in STOP_WORDS:
            out.setdefault(stem(w), []).append(i)
    return out


def plain(texts, question):
    q, out = parsed(question), {}
    for i, text in texts:
        p = places(text)
        hold = lambda phrase: any(all(at + o in p.get(t, ()) for t, o in phrase) for at in p.get(phrase[0][0], ()))
        if not q.groups or not all(any(hold(x) for x in g) for g in q.groups) or any(hold(x) for x in q.banned):
            continue
        wanted = q.wanted
        if len(wanted) > 1 and all(len(g) == 1 for g in q.groups):
            left = 1.0
            for n, a in enumerate(wanted):
                for b in wanted[:n]:
                    for x in p[a]:
                        for y in p[b]:
                            if 0 < abs(x - y) <= 100:
                                left *= 1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))
            out[i] = max(1 - left, 1e-20)
        else:
            out[i] = sum(0.1 * sum(1 / j**2 for j in range(1, len(p.get(t, ())) + 1)) / 1.64493406685 for t in wanted) / len(wanted)
    return out


WORDS = "search searching searched engine engines the of a query queries index indexing graph memory relational relation run running fast".split()


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    return [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 60)))) for i in range(250)] + [(900, None), (901, ""), (902, "the of a"), (903, "Search, the ENGINE! " * 400)]


QUESTIONS = ["search engine", '"search engine"', '"searching the engines" fast', "search or graph", "memory -graph", 'index -"fast run"', '"query index" or "graph memory" engine', "running", "the of", "-search", "zzz", '"search', "or search", "relations of memories"]


def test_questions(spark, texts):
    index = TextIndex.build(spark.createDataFrame(texts, "id long, content string"))
    for q in QUESTIONS:
        got = {r.id: r.rank_score for r in index.matches(q).collect()}
        want = plain(texts, q)
        assert set(got) == set(want), q
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want), q
    assert len(plain(texts, "search engine")) > 20 and len(plain(texts, '"search engine"')) < len(plain(texts, "search engine"))


def test_only_the_terms_are_read(spark, texts):
    index = TextIndex.build(spark.createDataFrame(texts, "id long, content string"))
    assert "PushedFilters: [In(term, [engin,search])]" in index.postings(["engin", "search"])._jdf.queryExecution().toString()


def test_changes(spark, texts):
    rows = [(i, t, float(i % 3)) for i, t in texts]
    index = TextIndex.build(spark.createDataFrame(rows, "id long, content string, importance double"), payload=["importance"])
    new = [(0, "search engine", 9.0), (1000, "search engine engine", 8.0)]
    index.add(spark.createDataFrame(new, "id long, content string, importance double"), payload=["importance"])
    index.remove(spark.createDataFrame([(i,) for i in range(5, 50)], "id long"))
    now = [(i, t) for i, t in texts if i and not 5 <= i < 50] + [(0, new[0][1]), (1000, new[1][1])]
    want = plain(now, "search engine")
    assert {r.id for r in index.matches("search engine").collect()} == set(want)
    top = index.search("search engine", 5, order=[F.desc("importance")]).collect()
    assert [r.id for r in top] == sorted(want, key=lambda i: (-want[i], -{r[0]: r[2] for r in rows + new}[i], i))[:5]
    assert all(r.id % 2 == 0 for r in index.search("search", None, only=F.col("id") % 2 == 0).collect())
    assert TextIndex.build(spark.createDataFrame([], "id long, content string")).matches("search").count() == 0
