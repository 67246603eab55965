"""Queries that complete earlier ones: access tracking, ages, top lists, bundles, recall without vectors, stored errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, graph, ingest, jobs, joins, maintain, retrieval, stats
from . import providers
from .catalog import SQL, SYM, TOK, TS, WORDS, query, relation_pairs
from .fixtures import AS_OF, CTE


@query(f"SELECT id, CASE WHEN id = 7 THEN access_count + 1 ELSE access_count END AS access_count, coalesce(CASE WHEN id = 7 THEN {TS} ELSE last_accessed_at END = {TS}, FALSE) AS just_now FROM memories")
def memory_access(t):
    m = filters.looked_up(t.memories, 7, AS_OF)
    return m.select("id", "access_count", F.coalesce(F.col("last_accessed_at") == F.lit(AS_OF).cast("timestamp"), F.lit(False)).alias("just_now"))


@query("SELECT p.id, coalesce(n, 0) AS links FROM part_entities p LEFT JOIN (SELECT entity_id, count(*) AS n FROM part_links GROUP BY 1) l ON l.entity_id = p.id WHERE coalesce(n, 0) <= 25 AND p.id % 40 > 20")
def noise_prune_aged(t):
    parts = t.part_entities.withColumn("created_at", stats.ago(AS_OF, 0) - F.make_dt_interval(days=(F.col("id") % 40).cast("int")))
    return joins.prunable(parts, t.part_links, 25, as_of=AS_OF, hours=20 * 24).select("id", "links")


@query("SELECT 'category' AS kind, category AS name, count(*) AS n FROM memories WHERE category IS NOT NULL GROUP BY 2 UNION ALL SELECT 'machine', source_machine, count(*) FROM memories WHERE source_machine IS NOT NULL GROUP BY 2 UNION ALL SELECT 'model', coalesce(embedding_model, 'unknown'), count(*) FROM memories GROUP BY 2")
def pulse_lists(t):
    return stats.pulse_lists(t.memories, 10)


@query(f"""SELECT * FROM (SELECT 'total' AS kind, 'memories' AS name, count(*) AS n FROM memories UNION ALL SELECT 'total', 'last_day', count(*) FILTER (WHERE created_at >= {TS} - INTERVAL 24 HOUR) FROM memories
 UNION ALL (SELECT 'category', category, count(*) AS n FROM memories WHERE category IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5) UNION ALL (SELECT 'event', event_type || ' ' || id, epoch_us(created_at) FROM agent_events ORDER BY created_at DESC, id DESC LIMIT 5))""")
def briefing(t):
    return stats.briefing(t.memories, t.agent_events, AS_OF)


@query(f"""SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'error' AND created_at >= {TS} - INTERVAL 168 HOUR) AS errors_week, count(*) FILTER (WHERE event_type = 'task_complete') AS done, count(*) FILTER (WHERE event_type = 'insight_processed') AS processed,
 (SELECT count(*) FROM memories WHERE summary IS NULL) AS unsummarised, (SELECT count(*) FROM memories WHERE quality_score IS NULL) AS unscored, (SELECT count(*) FROM memories WHERE extraction_status IS NULL OR extraction_status = 'failed') AS unextracted, (SELECT count(*) FROM entities WHERE description IS NULL OR length(description) < 20) AS undescribed FROM agent_events""")
def scheduler_counts(t):
    return stats.scheduler_counts(t.agent_events, t.memories, t.entities, AS_OF)


@query("SELECT regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS top, regexp_extract(url, '^https?://[^/]+/[^/?#]*/([^/?#]*)', 1) AS second, count(*) AS files FROM pages WHERE url IS NOT NULL GROUP BY 1, 2")
def path_tree(t):
    paths = t.raw("pages").where("url is not null").select(F.regexp_replace("url", r"^https?://[^/]+/?", "").alias("path"))
    return stats.path_tree(paths.select(F.regexp_replace("path", r"[?#].*", "").alias("path")))


@query(f"SELECT coalesce(a.id, b.id) AS id, a.importance, round(b.stability, 4) AS stability FROM ({SQL['importance_recompute']}) a FULL JOIN ({SQL['stability_decay']}) b ON a.id = b.id")
def maintenance_bundle(t):
    return maintain.bundle(t.memories, t.entity_memories, AS_OF).select("id", F.round("importance", 4).alias("importance"), F.round("stability", 4).alias("stability"))


@query("SELECT id, CASE WHEN id = 1 THEN s ELSE 'now' END AS category FROM (SELECT o_custkey AS id, first(o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY 1)")
def version_restore_one(t):
    o = t.raw("orders").selectExpr("o_custkey as id", "o_orderkey as at", "o_orderstatus as category")
    now = o.select("id").distinct().withColumn("category", F.lit("now"))
    return maintain.restored(now, maintain.versions(o, ["category"]), 1, 0, ["category"])


@query(f"SELECT id, round(s, 4) AS score FROM ({WORDS}) ORDER BY s DESC, importance DESC, id LIMIT 20")
def smart_recall_by_words(t):
    return retrieval.smart_recall(t.memories, None, "attion ertion", 50, AS_OF).select("id", F.round("score", 4).alias("score"))


@query()
def stemmed_recall(t):
    return retrieval.stemmed_search(t.memories, "the attions of ertion", None).select("id", F.round("rank_score", 4).alias("rank_score"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN NULL ELSE lang END AS name FROM documents")
def coerced_names(t):
    q = F.to_json(F.struct(F.col("lang").alias("name")))
    shapes = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('"'), "lang", F.lit('"'))).when(F.col("doc_id") % 5 == 1, q).when(F.col("doc_id") % 5 == 2, F.concat(F.lit('{"topic": '), q, F.lit("}"))).when(F.col("doc_id") % 5 == 3, F.concat(F.lit('{"node": '), q, F.lit("}"))).otherwise(F.lit("[1"))
    return t.raw("documents").select("doc_id", T.name_of(shapes).alias("name"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE 'Part ' || chunk_index || ' of ' || document_id || '. ' END || coalesce(category || '. ', '') || array_to_string(tags, ', ') || '. ' || left(content, 50) AS embed_text FROM memories WHERE content IS NOT NULL")
def contextual_prefix(t):
    m = t.memories.where("content is not null")
    said = F.when(F.col("id") % 3 == 0, F.lit("  x ")).otherwise(F.concat_ws(" ", F.lit("Part"), F.col("chunk_index").cast("string"), F.lit("of"), F.col("document_id").cast("string")))
    return m.select("id", T.with_prefix(said, F.col("category"), F.col("tags"), F.left("content", F.lit(50))).alias("embed_text"))


@query("""SELECT event_id AS id, '## Error: e' || user_id || chr(10) || chr(10) || '**Context:** at ' || event_id || chr(10) || chr(10) || '**Solution:** restart' AS content, 'error-pattern,e' || user_id AS tags FROM events WHERE event_type = 'error'""")
def error_store(t):
    e = t.raw("events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.concat(F.lit("e"), "user_id").alias("error"), F.concat(F.lit("at "), "event_id").alias("context"), F.lit("restart").alias("solution"), F.array(F.concat(F.lit("e"), "user_id")).alias("tags"))
    return ingest.error_patterns(e).select("id", "content", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT id, source_machine AS language, tags[1] AS kind FROM (SELECT id, source_machine, tags, importance, len(list_filter({TOK}, lambda x: x = 'attion')) / ln(len({TOK}) + exp(1)) AS s FROM memories WHERE list_contains({TOK}, 'attion') AND list_has_any(tags, ['en'])) ORDER BY s DESC, importance DESC, id LIMIT 15")
def code_search(t):
    rows = t.memories.withColumn("symbol", F.struct(F.col("source_machine").alias("language"), F.col("tags")[0].alias("kind")))
    return retrieval.code_search(rows, "attion", ["en"], 15)


@query("SELECT id, left(content, 60) AS answer FROM (SELECT id, content, row_number() OVER (ORDER BY created_at DESC, id) AS r FROM memories WHERE content IS NOT NULL) WHERE r <= 10")
def distilled_search(t):
    hits = filters.newest(t.memories.where("content is not null"), 10)
    return jobs.compressed(hits, lambda df: df.withColumn("answer", F.left("content", F.lit(60)))).select("id", "answer")


@query(f"SELECT component, count(*) AS n FROM (WITH RECURSIVE s AS ({SYM}), r(node, reached) AS (SELECT u, u FROM s UNION SELECT r.node, s.v FROM r JOIN s ON s.u = r.reached) SELECT node, min(reached) AS component FROM r GROUP BY 1) GROUP BY 1")
def components_or_all(t):
    """No component has so many nodes, so all are kept."""
    return graph.large_components(graph.components(relation_pairs(t)), 1_000_000_000).groupBy("component").agg(F.count("*").alias("n"))


@query()
def community_summaries(t):
    return ingest.community_summaries(graph.communities(t.entity_relations), t.entities, lambda df: df.withColumn("summary", F.left(F.array_join("members", "; "), F.lit(200))))
