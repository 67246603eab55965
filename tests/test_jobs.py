"""Stems, jobs' defined cases, crawls: what SQL on the supplied tables does not reach."""

import math
import re

from pyspark.sql import functions as F

from engram.functions import stems
from engram.functions import text as T
from engram.operators import crawl, graph, jobs, retrieval, writes
from engram.plans import catalog, catalog_jobs, catalog_more  # noqa: F401

AS_OF = "2024-02-01 00:00:00"
#: Pairs that the published algorithm states.
PORTER = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "feed": "feed", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formality": "formal", "sensitivity": "sensit", "triplicate": "triplic", "formative": "form", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "replacement": "replac", "adjustment": "adjust", "adoption": "adopt", "communism": "commun",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems():
    assert {w: stems.stem(w) for w in PORTER} == PORTER
    assert stems.terms("The cats and THE cat, motoring") == ["cat", "motor"] and stems.terms("the of") == []


def test_stemmed_search(spark):
    m = spark.createDataFrame([(1, "Relational operators relate", 0.1), (2, "cats", 0.2), (3, None, 0.3), (4, "the relation of an operator " * 300, 0.4), (5, "", None)], "id long, content string, importance double")
    got = {r.id: r.rank_score for r in retrieval.stemmed_search(m, "the relating operation", None).collect()}
    want = {}
    for r in m.collect():
        words = re.findall("[a-z0-9]+", (r.content or "").lower())
        found = [stems.stem(w) for w in words if w not in stems.STOP_WORDS]
        if all(t in found for t in ("relat", "oper")):
            want[r.id] = sum(found.count(t) for t in ("relat", "oper")) / math.log(len(words) + math.e)
    assert set(got) == set(want) == {1, 4} and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert retrieval.stemmed_search(m, "the of", None).count() == 0


def test_crawl(spark):
    pages = spark.createDataFrame([(f"http://a.org/{i}", "".join(f'<a href="/{j}">x</a>' for j in (2 * i + 1, 2 * i + 2)) + "text " * 20) for i in range(12)] + [("http://a.org/3", "again")], "url string, html string")
    seeds = spark.createDataFrame([("http://a.org/0",), (None,)], "url string")
    got = {r.url[13:]: r.depth for r in crawl.crawled(seeds, crawl.page_fetcher(pages), 2, 50).collect()}
    assert got == {"0": 0, "1": 1, "2": 1, "3": 2, "4": 2, "5": 2, "6": 2}
    few = crawl.crawled(seeds, crawl.page_fetcher(pages), 5, 4, exclude="/1$").collect()
    assert [r.depth for r in sorted(few, key=lambda r: r.depth)] == [0, 1, 2, 2]
    kept = crawl.stored(crawl.crawled(seeds, crawl.page_fetcher(pages), 0, 9), AS_OF)
    assert kept["documents"].count() == 1 and kept["signals"].first().strength == 2.0


def test_distilled_failures(spark):
    w = spark.createDataFrame([(1, 0, "x" * 120), (1, 1, "short"), (2, 0, "y" * 120), (3, 0, "z" * 10)], "conv_id long, window int, text string")
    titles = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Untitled"), (4, "None")], "conv_id long, title string")
    judge = lambda df: df.withColumn("learnings", F.expr("case when conv_id = 2 then null else array(named_struct('content', repeat('l', 30), 'confidence', 9.0D)) end"))
    out = jobs.distilled(w, titles, judge, AS_OF)
    assert {r.conv_id: (r.windows, r.learnings) for r in out["marks"].collect()} == {1: (1, 1), 3: (0, 0), 4: (0, 0)}
    assert [(r.content[:5], r.confidence) for r in out["memories"].collect()] == [("[One]", 1.0)]


def test_extraction_cases(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, content string")
    rule = lambda df: df.select("id", F.expr("case when id = 2 then null when id = 1 then array(named_struct('name', 'Postgres', 'entity_type', 'technology', 'description', 'd'), named_struct('name', ' postgres ', 'entity_type', 'technology', 'description', 'e'), named_struct('name', 'ab', 'entity_type', 'concept', 'description', null)) else array() end").alias("entities"), F.expr("array(named_struct('source', 'Postgres', 'target', 'ab', 'relationship_type', 'uses', 'confidence', 1.0D))").alias("relationships"))
    out = jobs.extracted(m, rule, T.is_noise)
    assert {r.id: r.extraction_status for r in out["status"].collect()} == {1: "done", 2: "failed", 3: "done"}
    assert out["links"].count() == 1 and out["relations"].count() == 0
    none = spark.createDataFrame([], "id string, name string, canonical_name string, entity_type string, description string, mention_count long, created_at timestamp")
    e = writes.entities_upserted(none, out["mentions"], AS_OF).collect()
    assert [(x.name, x.canonical_name, x.mention_count, x.description) for x in e] == [("Postgres", "postgres", 2, "d")]


def test_text_helpers(spark):
    row = spark.createDataFrame([("é", '{"name": 3}', None)], "a string, b string, c string").select(T.composed(F.col("a")).alias("a"), T.name_of(F.col("b")).alias("b"), T.name_of(F.col("c")).alias("c")).first()
    assert row.a == "é" and row.b == "3" and row.c is None


def test_large_components(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 7)], "node long, component long")
    assert {r.node for r in graph.large_components(c, 3).collect()} == {1, 2, 3}
    assert graph.large_components(c, 4).count() == 4


def shown(spark, folder, name, pages):
    """A query's rows over pages (page_id, url, html), and those of its SQL."""
    import duckdb

    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return sorted((tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).collect()), key=repr), sorted(con.execute(catalog.SQL[name]).fetchall(), key=repr)


#: Urls that several pages have, empty and null pages, and a reference both as a path and absolute.
TWICE = [(0, "http://a.org/x", '<a href="/y">y</a><a href="http://a.org/y">y</a>'), (1, "http://a.org/x", "plain"), (2, "http://a.org/z", ""), (4, "http://a.org/z", "same"), (6, "http://a.org/z", "same"), (3, "http://a.org/odd", "odd"), (8, "http://a.org/n", None), (10, None, "none"), (11, None, "none")]


def test_pages_of_one_url_are_rows_each(spark, tmp_path):
    got, want = shown(spark, tmp_path, "crawl_fetch", TWICE)
    assert got == want and len(got) == 6


def test_queue_rows_of_one_url_are_marked_each(spark, tmp_path):
    got, want = shown(spark, tmp_path, "queue_mark", TWICE)
    assert got == want and sum(crawled for _, crawled in got) == 5
