"""Queries whose SQL has no LIMIT give every row."""

from pyspark.sql import functions as F

from engram.operators import retrieval, stats
from engram.plans import catalog
from engram.plans.fixtures import AS_OF, Tables


def test_all_topics(spark, monkeypatch):
    signals = spark.range(1500).select(F.concat(F.lit("t"), "id").alias("topic"), F.lit(1.0).alias("strength"), F.lit(AS_OF).cast("timestamp").alias("created_at"))
    monkeypatch.setattr(Tables, "interest_signals", property(lambda self: signals))
    assert catalog.QUERIES["hot_topics"](spark, "").count() == 1500
    assert stats.hot_topics(signals, AS_OF, 30.0, 10).count() == 10


def test_all_hits(spark, monkeypatch):
    memories = spark.range(1_000_100).select("id", F.lit("attion").alias("content"), F.lit(0.5).alias("importance"))
    monkeypatch.setattr(Tables, "memories", property(lambda self: memories))
    assert catalog.QUERIES["text_recall_syntax"](spark, "").count() == 1_000_100
    assert retrieval.text_search(memories, "attion", 3).count() == 3
