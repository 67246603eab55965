"""Importers and providers that no query calls."""

import json

from pyspark.sql import functions as F

from engram.operators import jobs
from engram.plans import providers
from engram.sources import importers


def test_claude_memories(spark):
    text = json.dumps([{"conversations_memory": "  likes whole texts, and tests of them  "}, {"conversations_memory": "short"}, {"other": 1}])
    df = spark.createDataFrame([(text,), ("no json",), ("[]",)], "text string")
    assert [tuple(r) for r in importers.claude_memories(df).collect()] == [("likes whole texts, and tests of them", "claude", 0.8)]


def test_instruction_files(spark):
    rows = [("/x/projects/one/CLAUDE.md", " use Spark for it "), ("/x/projects/two/memory/notes.md", "remember this one"), ("/x/CLAUDE.md", "too short"), ("/x/README.md", "not an instruction file"), ("/x/memory/deep/er.md", "not directly in the folder"), ("/x/projects/one/notCLAUDE.md", "another file's name")]
    got = {r.source_ref: (r.content, r.project, r.confidence) for r in importers.instruction_files(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"/x/projects/one/CLAUDE.md": ("use Spark for it", "one", 0.9), "/x/projects/two/memory/notes.md": ("remember this one", "two", 0.8)}


def test_reranked(spark):
    df = spark.createDataFrame([(1, "s", "a" * 2000), (2, None, "bb"), (3, "long summary", None)], "id long, summary string, content string")
    assert [r.id for r in providers.reranked(df, lambda texts: [float(len(t)) for t in texts], 2).collect()] == [1, 3]
    assert [r.rerank for r in providers.reranked(df, lambda texts: [float(len(t)) for t in texts], 3).collect()] == [1003.0, 14.0, 4.0]
    assert providers.reranked(df, None, 2).count() == 2


def test_search_questions():
    def broken(_):
        raise ConnectionError

    assert providers.search_questions("What is it?") == [("What is it?", "What is it?")]
    assert providers.search_questions("Q", broken, broken, broken) == [("Q", "Q")]
    got = providers.search_questions("Q", lambda q: ["q", "A", " a ", "b", "c", "d"], lambda q: ["B", "p1", "p2", "P1", "p3", "p4", "p5"], lambda q: "a long hypothetical answer")
    assert got == [("a long hypothetical answer", "Q"), ("A", "A"), ("b", "b"), ("c", "c"), ("p1", "p1"), ("p2", "p2"), ("p3", "p3"), ("p4", "p4")]
    assert providers.search_questions("Q", hypothesise=lambda q: "too short")[0] == ("Q", "Q")


def test_learnings_go_through_the_write_path(spark):
    schema = "id long, content string, tags array<string>, category string"
    new = spark.createDataFrame([(1, "a learning that is new", ["x"], "data"), (2, "a learning known already", None, None), (3, "short", None, None), (4, "a better one of six", ["y"], None), (5, "it takes the place of seven", None, "ops")], schema)
    stored = spark.createDataFrame([(6, "six", ["old"], "data"), (7, "seven", ["old"], "data"), (8, "eight", None, None)], schema)
    pairs = spark.createDataFrame([(2, 8, 0.99), (4, 6, 0.9), (5, 7, 0.95), (5, 6, 0.86), (1, 8, 0.5)], "new_id long, old_id long, similarity double")
    verdict = F.element_at(F.create_map(*[F.lit(x) for kv in {2: "noop", 4: "Update", 5: "SUPERSEDE"}.items() for x in kv]), F.col("id").cast("int"))
    judge = lambda rows: rows.withColumn("answer", F.struct(verdict.alias("action"), F.lit(99).cast("long").alias("target_id"), F.lit("").alias("content")))
    out = jobs.reflected_through(new, stored, providers.write_candidates(pairs), judge)
    assert {(r.id, r.supersedes) for r in out["inserted"].collect()} == {(1, None), (5, 7)} and [r.id for r in out["skipped"].collect()] == [2]
    rows = {r.id: (r.content, r.tags, r.category, r.archived_reason) for r in out["stored"].collect()}
    assert rows == {6: ("a better one of six", ["y"], "data", None), 7: ("seven", ["old"], "_archived", "superseded"), 8: ("eight", None, None, None)}
