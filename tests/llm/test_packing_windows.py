"""Sequences stay open over all windows of a partition."""

import collections

from engram.llm import packing
from engram.llm.queries import tokenizer_path


def test_later_pieces_fill_earlier_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 100)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "100")  # a window ends with a batch at the earliest
    texts = [" a" * 599] * 300 + [" a" * 399] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    try:
        rows = packing.pack(df, tokenizer_path("byte_bpe_50k.json")).collect()
    finally:
        spark.conf.set(batch, before)
    assert sorted(r.length for r in rows) == [400] * 300 + [600] * 300 and {r.doc_id for r in rows} == set(range(600))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert len(by) == 300 and all(sorted(x) in ([(0, 600), (600, 400)], [(0, 400), (400, 600)]) for x in by.values())


def test_partitions_of_several_segments(spark, monkeypatch):
    """Segments of a partition are leaves of the tree: their open sequences are joined."""
    monkeypatch.setattr(packing, "WINDOW", 40)
    monkeypatch.setattr(packing, "SEGMENT", 80)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "40")
    texts = [" a" * 599] * 100 + [" a" * 399] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    try:
        rows = packing.pack(df, tokenizer_path("byte_bpe_50k.json")).collect()
    finally:
        spark.conf.set(batch, before)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 200
    for x in by.values():
        ends = [o + n for o, n in sorted(x)]
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(by) < 150  # 64 of each segment's go up
