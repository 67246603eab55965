"""The pipeline's stages, one after the other, each held against what it should keep."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_operators import near_brute

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 400")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "No identifier, but a clean text of the usual kind. " * 3, "en", "s", 5), (9000, "", "en", "s", 0)], docs.schema)
    docs, out = docs.unionByName(odd), []
    for _, stage in P.STAGES:
        rows = stage(spark, docs, DATA).collect()
        out.append((docs.collect(), rows))
        if stage is not P.STAGES[-1][1]:
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_quality_stage(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    bad = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.4 * len(bad)
    assert set(map(tuple, after)) <= set(map(tuple, before))


def test_near_stage(stages):
    before, after = stages[1]
    rows = [(i, r.text or "") for i, r in enumerate(before)]
    root = near_brute(rows, 5)
    groups = collections.Counter(root.values())
    assert len(after) == len(groups) and set(map(tuple, after)) <= set(map(tuple, before))


def test_repeats_stage(stages):
    before, after = stages[2]
    assert len(before) == len(after)
    was = {r.doc_id: r.text for r in before if r.doc_id is not None}
    counts = collections.Counter()
    for r in before:
        t = (r.text or "").encode()
        counts.update({t[i : i + 200] for i in range(0, len(t) - 199)})
    for r in after:
        t = was.get(r.doc_id)
        assert r.text is None or r.n_chars == len(r.text)
        if t and not any(counts[t.encode()[i : i + 200]] > 1 for i in range(len(t.encode()) - 199)) and len(t) > 400 and len(set(t.encode()[i : i + 200] for i in range(len(t.encode()) - 199))) == len(t.encode()) - 199:
            assert r.text == t


def test_secret_stage(stages):
    from engram.llm.secrets import base_spans

    before, after = stages[3]
    assert len(before) == len(after) and not any(base_spans(r.text or "") for r in after)
    assert sum(a.text == b.text for a, b in zip(sorted(before, key=str), sorted(after, key=str))) > 0.8 * len(before)


def test_packing_stage(stages):
    before, after = stages[4]
    assert len({(r.doc_id, r.piece) for r in after if r.doc_id is not None}) == len([r for r in after if r.doc_id is not None])
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").where("doc_id < 120").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).agg(F.max("length")).first()[0] <= 1024
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(str(tmp_path / "e" / "labels.parquet"))
    assert P.run(spark, str(tmp_path / "e")).count() == 0
