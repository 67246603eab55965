"""Every operator as a query over the supplied tables, with the same query for DuckDB where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import relevance
from ..operators import filters, graph, joins, maintain, retrieval, stats, windows
from .fixtures import AS_OF, Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TS = f"TIMESTAMP '{AS_OF}'"


def query(sql: str | None = None):
    """Register a query, and the same query in SQL where there is one."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_tables(sql)
        return f

    return add


def query_vector(t: Tables, vec_id: int = 0) -> list[float]:
    """The vector of one row: a search's input, not data to compute on."""
    row = t.raw("embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding] if row else []


QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
COS = f"list_cosine_similarity(embedding::DOUBLE[], {QV})"
REL = f"0.65 * sim + 0.15 * coalesce(quality_score, 0.5) + 0.10 * coalesce(importance, 0.5) + 0.10 * exp(-0.00385 * (epoch({TS}) - epoch(created_at)) / 86400.0)"


# --- filters and projections ---


@query("SELECT id, category, source_type FROM memories WHERE list_has_any(tags, ['en', 'fr']) AND category = 'data' AND source_type = 'claude' ORDER BY created_at DESC, id LIMIT 20")
def filter_dynamic(t):
    return filters.newest(filters.matching(t.memories, tags=["en", "fr"], category="data", source_type="claude"), 20).select("id", "category", "source_type")


@query("SELECT id, round(quality_score, 4) AS quality_score FROM memories WHERE list_has_all(regexp_split_to_array(lower(content), '[^a-z0-9]+'), ['attion']) AND quality_score >= 0.5 ORDER BY created_at DESC, id LIMIT 10 OFFSET 5")
def query_structured(t):
    return filters.structured_query(t.memories, "attion", 0.5, 10, 5).select("id", F.round("quality_score", 4).alias("quality_score"))


@query("SELECT id, content, source_machine FROM memories WHERE id = 7")
def memory_by_id(t):
    return filters.by_id(t.memories, 7).select("id", "content", "source_machine")


@query("SELECT id FROM memories WHERE summary IS NULL AND length(content) > 50 ORDER BY created_at, id LIMIT 15")
def unsummarised(t):
    return filters.unsummarised(t.memories, 15).select("id")


@query("SELECT id FROM memories WHERE quality_score IS NULL AND category <> '_archived' AND length(content) > 20 ORDER BY created_at DESC, id LIMIT 15")
def unscored(t):
    return filters.unscored(t.memories, 15).select("id")


@query("SELECT id, extraction_status FROM memories WHERE extraction_status IS NULL OR extraction_status = 'failed' ORDER BY created_at, id LIMIT 15")
def unextracted(t):
    return filters.unextracted(t.memories, 15).select("id", "extraction_status")


@query(f"SELECT id, access_count FROM memories WHERE category <> '_archived' AND source_type = 'crawl' AND created_at < {TS} - INTERVAL 30 DAY ORDER BY access_count DESC NULLS LAST, importance DESC NULLS LAST, id LIMIT 20")
def stale_crawled(t):
    return filters.stale_crawled(t.memories, AS_OF, 30, 20).select("id", "access_count")


@query("SELECT id, category FROM memories WHERE category = 'backend' AND source_machine = 'm3' ORDER BY created_at DESC, id LIMIT 10 OFFSET 2")
def timeline_page(t):
    return filters.newest(filters.matching(t.memories, category="backend", source_machine="m3"), 10, 2).select("id", "category")


@query("SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM memories GROUP BY 1")
def timeline_by_day(t):
    return filters.timeline_by_day(t.memories)


@query("SELECT id, name, mention_count FROM entities WHERE entity_type = 'project' ORDER BY mention_count DESC, id LIMIT 10")
def entity_list(t):
    return filters.page(t.entities.where("entity_type = 'project'"), F.desc("mention_count"), limit=10, most=500).select("id", "name", "mention_count")


@query("SELECT id, name, entity_type, description FROM entities WHERE id = 5")
def entity_by_id(t):
    return filters.by_id(t.entities, 5).select("id", "name", "entity_type", "description")


@query("SELECT id, event_type FROM agent_events ORDER BY created_at DESC, id LIMIT 25")
def recent_events(t):
    return filters.newest(t.agent_events, 25).select("id", "event_type")


@query("SELECT page_id AS id, url FROM pages ORDER BY page_id LIMIT 10")
def queue_head(t):
    return filters.page(t.raw("pages").withColumnRenamed("page_id", "id"), F.asc("id"), limit=10).select("id", "url")


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0 AND url IS NOT NULL)")
def unseen_urls(t):
    p = t.raw("pages")
    return filters.unseen(p.where("url is not null"), p.where("page_id % 3 = 0"), ["url"]).select("page_id", "url")


@query(f"SELECT id FROM memories WHERE len(list_intersect(tags, ['en', 'src3'])) = 2 AND created_at >= {TS} - INTERVAL 720 HOUR")
def both_tags(t):
    return filters.with_all_tags(t.memories, ["en", "src3"], AS_OF, 720).select("id")


@query("SELECT source_type, count(*) AS n, max(length(content)) AS longest FROM memories WHERE length(content) > 8000 GROUP BY 1")
def oversized(t):
    return filters.oversized(t.memories, 8000)


@query("SELECT DISTINCT category FROM memories WHERE category IS NOT NULL")
def categories(t):
    return t.memories.where("category is not null").select("category").distinct()


@query("SELECT CAST(id AS VARCHAR) AS id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, round(confidence, 4) AS confidence FROM memories")
def shaped_rows(t):
    return filters.shaped(t.memories.select("id", "created_at", "confidence"))


@query("SELECT id FROM memories WHERE coalesce(quality_score, 0) >= 0.8 ORDER BY created_at DESC, id LIMIT 20")
def quality_page(t):
    return filters.quality_page(t.memories, 0.8, 20).select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_load(t):
    return filters.unseen(t.raw("documents"), t.raw("labels"), ["doc_id"]).select(F.col("doc_id").alias("id"))


# --- joins ---


@query("SELECT m.id, round(l.confidence, 2) AS link_confidence FROM entity_memories l JOIN memories m ON m.id = l.memory_id WHERE l.entity_id = 3")
def entity_memories_join(t):
    return joins.entity_memories_of(t.memories, t.entity_memories, 3).select("id", F.round("link_confidence", 2).alias("link_confidence"))


@query("SELECT e.id, e.name, e.entity_type FROM entity_memories l JOIN entities e ON e.id = l.entity_id WHERE l.memory_id = 3")
def memory_entities_join(t):
    return joins.memory_entities_of(t.entities, t.entity_memories, 3).select("id", "name", "entity_type")


@query("SELECT r.id, CASE WHEN source_id = 82 THEN 'outgoing' ELSE 'incoming' END AS direction, relationship_type, e.name AS other_name FROM entity_relations r LEFT JOIN entities e ON e.id = CASE WHEN source_id = 82 THEN target_id ELSE source_id END WHERE valid AND (source_id = 82 OR target_id = 82)")
def entity_connections(t):
    return joins.connections_of(t.entities, t.entity_relations, 82).select("id", "direction", "relationship_type", "other_name")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.35")
def similar_pairs(t):
    v = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return joins.similar_pairs(v, 0.35).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
 WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.25 AND (a.vec_id, b.vec_id) NOT IN (SELECT (least(x, y), greatest(x, y)) FROM (SELECT (user_id * 31) % n AS x, event_id % n AS y FROM events, n))""")
def unchecked_pairs(t):
    """Similar pairs that no event has marked as checked, whichever way round the marker names them."""
    v = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    n = v.agg(F.count("*").alias("n"))
    marks = t.raw("events").join(F.broadcast(n), F.col("n") > 0).selectExpr("(user_id * 31) % n as a", "event_id % n as b")  # n is one row
    return joins.similar_pairs(v, 0.25, checked=marks).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query("""SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM memories a JOIN memories b ON a.id < b.id
 WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND a.category <> '_archived' AND b.category <> '_archived' AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) BETWEEN 0.30 AND 0.45
 AND (a.source_machine IS DISTINCT FROM b.source_machine OR a.source_type <> b.source_type OR a.created_at < b.created_at - INTERVAL 7 DAY)""")
def contradiction_pairs(t):
    return joins.contradiction_pairs(t.memories, 0.30, 0.45).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query("SELECT a.id AS a, b.id AS b, a.canonical_name AS name, CAST(a.mention_count + b.mention_count AS BIGINT) AS mentions FROM part_entities a JOIN part_entities b ON a.canonical_name = b.canonical_name AND a.id < b.id AND a.entity_type <> b.entity_type")
def same_name_pairs(t):
    return joins.same_name_pairs(t.part_entities)


CO = "SELECT a.entity_id AS e1, b.entity_id AS e2, count(*) AS shared, list_sort(list(a.memory_id))[1:3] AS s FROM entity_memories a JOIN entity_memories b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 3"


@query(f"SELECT e1, e2, shared, array_to_string(s, ',') AS sample FROM ({CO}) WHERE NOT EXISTS (SELECT 1 FROM entity_relations r WHERE (r.source_id = e1 AND r.target_id = e2) OR (r.source_id = e2 AND r.target_id = e1))")
def cooccurrence_unlinked(t):
    pairs = joins.unlinked(joins.cooccurrences(t.entity_memories, 3), t.entity_relations)
    return pairs.select("e1", "e2", "shared", F.array_join("sample", ",").alias("sample"))


@query("SELECT id, event_type FROM agent_events WHERE event_type IN ('error', 'task_complete', 'decision') AND id NOT IN (SELECT source_event_id FROM agent_events WHERE event_type = 'insight_processed' AND source_event_id IS NOT NULL)")
def unprocessed_events(t):
    return joins.unprocessed(t.agent_events, ["error", "task_complete", "decision"]).select("id", "event_type")


@query("""SELECT e.id, e.name, n, array_to_string(ids[1:5], ',') AS newest FROM (SELECT l.entity_id, count(*) AS n, list(m.id ORDER BY m.created_at DESC, m.id) AS ids FROM entity_memories l JOIN memories m ON m.id = l.memory_id GROUP BY 1 HAVING count(*) >= 3) g
 JOIN entities e ON e.id = g.entity_id WHERE e.id % 7 <> 0""")
def synthesis_candidates(t):
    return joins.synthesis_candidates(t.entities, t.entity_memories, t.memories, t.entities.where("id % 7 = 0"), 3)


@query("SELECT e.id, e.name, count(*) AS n, max(l.memory_id) AS last_memory FROM entities e JOIN entity_memories l ON l.entity_id = e.id WHERE (e.description IS NULL OR length(e.description) < 20) AND e.mention_count >= 2 GROUP BY 1, 2")
def underdescribed(t):
    return joins.underdescribed(t.entities, t.entity_memories)


@query("SELECT e.id, e.name, count(DISTINCT m.source_machine) AS machines, count(*) AS n, array_to_string(list_sort(list(DISTINCT m.source_machine) FILTER (WHERE m.source_machine IS NOT NULL)), ',') AS names FROM entities e JOIN entity_memories l ON l.entity_id = e.id JOIN memories m ON m.id = l.memory_id GROUP BY 1, 2 HAVING count(DISTINCT m.source_machine) >= 2")
def cross_machine_clusters(t):
    return joins.cross_machine(t.entities, t.entity_memories, t.memories)


@query(f"SELECT e.id, e.name, l.memory_id FROM entities e JOIN entity_memories l ON l.entity_id = e.id WHERE e.created_at >= {TS} - INTERVAL 7 DAY AND e.id % 5 <> 0")
def extraction_samples(t):
    return joins.extraction_samples(t.entities, t.entity_memories, t.entities.where("id % 5 = 0"), AS_OF, 7).select("id", "name", "memory_id")


@query("SELECT e.id, e.name, e.mention_count, count(DISTINCT l.memory_id) AS n_memories FROM entities e LEFT JOIN entity_memories l ON l.entity_id = e.id WHERE e.entity_type IN ('technology', 'concept') AND e.mention_count >= 5 AND e.id % 4 <> 0 GROUP BY 1, 2, 3")
def research_candidates(t):
    return joins.research_candidates(t.entities, t.entity_memories, t.entities.where("id % 4 = 0"), ["technology", "concept"], 5)


NODES = "SELECT e.id, e.name, e.entity_type, c.n AS links FROM entities e JOIN (SELECT entity_id, count(*) AS n FROM entity_memories GROUP BY 1) c ON c.entity_id = e.id WHERE c.n >= 3"


@query(NODES)
def graph_nodes(t):
    return joins.graph_nodes(t.entities, t.entity_memories, 3)


@query(f"SELECT r.id, source_id, target_id, relationship_type, round(confidence, 2) AS confidence FROM entity_relations r WHERE valid AND source_id IN (SELECT id FROM ({NODES})) AND target_id IN (SELECT id FROM ({NODES}))")
def graph_edges(t):
    return joins.graph_edges(t.entity_relations, joins.graph_nodes(t.entities, t.entity_memories, 3))


@query("SELECT h.id AS hit_id, string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.chunk_index, c.id) AS around FROM memories h JOIN memories c ON c.document_id = h.document_id AND abs(c.chunk_index - h.chunk_index) <= 1 WHERE h.id % 50 = 0 GROUP BY 1")
def chunk_neighbors(t):
    return joins.chunk_neighbours(t.memories.where("id % 50 = 0"), t.memories, 1)


@query("SELECT e.id, e.canonical_name, coalesce(c.n, 0) AS links FROM part_entities e LEFT JOIN (SELECT entity_id, count(*) AS n FROM part_links GROUP BY 1) c ON c.entity_id = e.id WHERE coalesce(c.n, 0) <= 1")
def noise_prune(t):
    return joins.prunable(t.part_entities, t.part_links)


@query("SELECT id FROM entity_relations WHERE source_id NOT IN (SELECT id FROM entities WHERE id % 9 <> 0) OR target_id NOT IN (SELECT id FROM entities WHERE id % 9 <> 0)")
def dangling_relations(t):
    return joins.dangling(t.entity_relations, t.entities.where("id % 9 <> 0")).select("id")


@query(f"SELECT f.memory_id, f.was_useful, m.category, epoch_us(f.created_at) AS at_us FROM (SELECT * FROM memory_outcomes WHERE created_at >= {TS} - INTERVAL 7 DAY ORDER BY created_at DESC, memory_id, was_useful LIMIT 50) f LEFT JOIN memories m ON m.id = f.memory_id")
def recent_feedback(t):
    return joins.recent_feedback(t.memory_outcomes, t.memories, AS_OF, 7, 50)


# --- aggregates ---


@query("SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(embedding) FROM memories) AS embedded, (SELECT count(*) FROM memories WHERE category = '_archived') AS archived, (SELECT count(*) FROM memories WHERE extraction_status = 'done') AS extracted, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM entity_relations) AS relations")
def stats_scalars(t):
    return stats.scalar_counts(t.memories, t.entities, t.entity_relations)


for _name, _column in (("stats_by_source", "source_type"), ("stats_by_category", "category"), ("stats_by_machine", "source_machine")):
    QUERIES[_name] = lambda spark, sf_dir, c=_column: stats.group_counts(Tables(spark, sf_dir).memories, c)
    SQL[_name] = with_tables(f"SELECT {_column} AS value, count(*) AS n FROM memories GROUP BY 1")


@query("SELECT entity_type AS value, count(*) AS n FROM entities GROUP BY 1")
def stats_entity_types(t):
    return stats.group_counts(t.entities, "entity_type")


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM memories) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20")
def tag_histogram(t):
    return stats.tag_histogram(t.memories, 20)


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM memories) GROUP BY 1")
def all_tags(t):
    return stats.tag_histogram(t.memories)


@query("SELECT coalesce(embedding_model, 'unknown') AS model, count(*) AS n FROM memories GROUP BY embedding_model")
def model_counts(t):
    return stats.model_counts(t.memories)


@query("SELECT count(DISTINCT document_id) FILTER (WHERE chunk_index IS NOT NULL) AS documents, count(*) FILTER (WHERE chunk_index IS NOT NULL) AS chunks FROM memories")
def document_counts(t):
    return stats.document_counts(t.memories)


@query("SELECT CAST(coalesce(tier, 2) AS BIGINT) AS tier, count(*) AS n FROM memories GROUP BY 1")
def tier_counts(t):
    return stats.tier_counts(t.memories)


@query(f"SELECT (SELECT count(*) FROM memory_outcomes) AS outcomes, (SELECT count(*) FROM memory_outcomes WHERE was_useful) AS useful, (SELECT count(*) FROM memories WHERE category = '_archived') AS archived, (SELECT count(*) FROM memories WHERE created_at >= {TS} - INTERVAL 1 DAY) AS last_day")
def feedback_totals(t):
    return stats.feedback_totals(t.memory_outcomes, t.memories, AS_OF)


@query(f"SELECT topic, round(sum(strength * exp(-((epoch_us({TS}) - epoch_us(created_at)) / 86400e6) / 30.0)), 4) AS score, count(*) AS n FROM interest_signals WHERE created_at >= {TS} - INTERVAL 90 DAY GROUP BY 1 HAVING sum(strength * exp(-((epoch_us({TS}) - epoch_us(created_at)) / 86400e6) / 30.0)) > 0.1")
def hot_topics(t):
    return stats.hot_topics(t.interest_signals, AS_OF, 30.0).select("topic", F.round("score", 4).alias("score"), "n")


@query("SELECT topic, epoch_us(max(created_at)) AS last FROM interest_signals GROUP BY 1")
def topic_last_seen(t):
    return stats.last_seen(t.interest_signals, "topic").select("topic", F.unix_micros("last").alias("last"))


@query("""SELECT domain, count(*) AS n, round(avg(CAST(novel AS DOUBLE)), 4) AS novelty, count(*) >= 3 AND avg(CAST(novel AS DOUBLE)) < 0.4 AS saturated FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id DESC) AS rn FROM agent_events WHERE domain IS NOT NULL) WHERE rn <= 20 GROUP BY 1""")
def domain_saturation(t):
    return stats.domain_saturation(t.agent_events, novelty=0.4).select("domain", "n", F.round("novelty", 4).alias("novelty"), "saturated")


@query(f"SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM memories WHERE created_at >= {TS} - INTERVAL 1 DAY) AS new_in_a_day, (SELECT count(DISTINCT source_machine) FROM memories) AS machines, (SELECT count(*) FROM memory_outcomes WHERE created_at >= {TS} - INTERVAL 7 DAY) AS feedback, (SELECT round(avg(CAST(was_useful AS DOUBLE)), 4) FROM memory_outcomes WHERE created_at >= {TS} - INTERVAL 7 DAY) AS hit_rate, (SELECT round(avg(n), 4) FROM (SELECT count(*) AS n FROM entity_relations WHERE valid GROUP BY source_id)) AS mean_out_degree")
def system_pulse(t):
    return stats.pulse(t.memories, t.memory_outcomes, t.entity_relations, AS_OF)


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'task_complete') AS task_complete, count(*) FILTER (WHERE event_type = 'decision') AS decision, count(*) FILTER (WHERE event_type = 'insight_processed') AS insight_processed, count(*) FILTER (WHERE event_type = 'crawl_outcome') AS crawl_outcome, count(*) AS total FROM agent_events")
def event_counts(t):
    return stats.event_counts(t.agent_events)


@query("SELECT event_type, epoch_us(max(created_at)) AS last_run, count(*) AS runs FROM (SELECT * FROM agent_events ORDER BY created_at DESC, id DESC LIMIT 100) GROUP BY 1")
def job_runs(t):
    return stats.job_runs(t.agent_events, 100).select("event_type", F.unix_micros("last_run").alias("last_run"), "runs")


# --- retrieval ---


@query(f"SELECT id, round(sim, 4) AS similarity, round({REL}, 4) AS relevance FROM (SELECT *, {COS} AS sim FROM memories WHERE embedding IS NOT NULL AND (embedding_model IS NULL OR embedding_model = 'current') AND tier < 3) WHERE sim >= 0.10 ORDER BY sim DESC, id LIMIT 30")
def vector_topk(t):
    near = retrieval.scored(t.memories, query_vector(t)).where("similarity >= 0.10").orderBy(F.desc("similarity"), "id").limit(30)
    return near.select("id", F.round("similarity", 4).alias("similarity"), F.round(relevance(F.col("similarity"), F.col("quality_score"), F.col("importance"), F.col("created_at"), AS_OF), 4).alias("relevance"))


NEAR = f"SELECT id, sim, {REL} AS relevance, created_at FROM (SELECT * FROM (SELECT *, {COS} AS sim FROM memories WHERE embedding IS NOT NULL AND (embedding_model IS NULL OR embedding_model = 'current') AND tier < 3) WHERE sim >= 0.10 ORDER BY sim DESC, id LIMIT %d) ORDER BY relevance DESC, id LIMIT %d"


@query(f"SELECT id, round(sim, 4) AS similarity, round(relevance, 4) AS relevance FROM ({NEAR % (30, 10)})")
def relevance_topk(t):
    return retrieval.vector_search(t.memories, query_vector(t), 10, 0.10, AS_OF).select("id", F.round("similarity", 4).alias("similarity"), F.round("relevance", 4).alias("relevance"))


@query(f"SELECT id, round(sim, 4) AS similarity FROM (SELECT id, {COS} AS sim FROM memories WHERE embedding IS NOT NULL AND id <> 0 ORDER BY sim DESC, id LIMIT 5) WHERE sim >= 0.3")
def duplicate_candidates(t):
    return retrieval.duplicate_candidates(t.memories, query_vector(t), 5, 0.3, exclude=0).select("id", F.round("similarity", 4).alias("similarity"))


TOK = "list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '')"
WORDS = f"SELECT id, importance, len(list_filter({TOK}, lambda x: x IN ('attion', 'ertion'))) / ln(len({TOK}) + exp(1)) AS s FROM memories WHERE list_has_all({TOK}, ['attion', 'ertion'])"


@query(f"SELECT id, round(s, 4) AS rank_score FROM ({WORDS}) ORDER BY s DESC, importance DESC, id LIMIT 50")
def text_recall(t):
    return retrieval.text_search(t.memories, "attion ertion", 50).select("id", F.round("rank_score", 4).alias("rank_score"))


@query(f"SELECT id, len(list_filter({TOK}, lambda x: x IN ('attion', 'thtion'))) AS hits FROM memories WHERE (list_contains({TOK}, 'attion') OR list_contains({TOK}, 'thtion')) AND NOT list_contains({TOK}, 'ertion')")
def text_recall_syntax(t):
    t_ = retrieval.tokens("content")
    return retrieval.text_search(t.memories, "attion or thtion -ertion", None).select("id", F.size(F.filter(t_, lambda x: x.isin("attion", "thtion"))).cast("long").alias("hits"))


@query(f"""SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS lists FROM (SELECT id, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM ({NEAR % (90, 30)})
 UNION ALL SELECT id, row_number() OVER (ORDER BY s DESC, importance DESC, id) AS rank FROM (SELECT w.* FROM ({WORDS}) w JOIN memories m ON m.id = w.id WHERE m.tier < 3 ORDER BY s DESC, w.importance DESC, w.id LIMIT 30)) GROUP BY 1 ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 10""")
def hybrid_rrf(t):
    return retrieval.hybrid_search(t.memories, query_vector(t), "attion ertion", 10, 0.10, AS_OF).select("id", F.round("score", 6).alias("score"), "lists")


@query()
def multi_query_search(t):
    return retrieval.multi_query(t.memories, [(query_vector(t, 0), "attion"), (query_vector(t, 1), "ertion")], 10, 0.10, AS_OF)


def entity_vectors(t: Tables) -> DataFrame:
    return t.entities.join(t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


EV = "SELECT e.*, v.embedding FROM entities e JOIN embeddings v ON v.vec_id = e.id"


@query(f"SELECT id, name, round({COS}, 4) AS similarity FROM ({EV}) ORDER BY {COS} DESC, id LIMIT 10")
def entity_vector_search(t):
    return retrieval.duplicate_candidates(entity_vectors(t), query_vector(t), 10, -1.0).select("id", "name", F.round("similarity", 4).alias("similarity"))


@query(f"SELECT id, round({COS}, 4) AS similarity FROM ({EV}) WHERE mention_count >= 2 ORDER BY {COS} DESC, id LIMIT 15")
def nearby_entities(t):
    return retrieval.duplicate_candidates(entity_vectors(t).where("mention_count >= 2"), query_vector(t), 15, -1.0).select("id", F.round("similarity", 4).alias("similarity"))


@query()
def graph_search(t):
    return retrieval.graph_search(t.memories, entity_vectors(t), t.entity_memories, t.entity_relations, query_vector(t), 10, 2, least=0.1).select("id", "importance")


@query()
def link_scores(t):
    return t.raw("pages").select("page_id", "url", retrieval.link_score(F.col("url"), ["example.com", "example.org", "example.net"], ["example.com"]).alias("score"))


# --- maintenance ---


@query("SELECT m.id, round(least(1.0, 0.4 * least(1.0, coalesce(c.n, 0) / 10.0) + 0.3 * coalesce(quality_score, 0.5) + 0.3 * coalesce(confidence, 0.7)), 4) AS importance FROM memories m LEFT JOIN (SELECT memory_id, count(*) AS n FROM entity_memories GROUP BY 1) c ON c.memory_id = m.id WHERE embedding IS NOT NULL")
def importance_recompute(t):
    return maintain.importance(t.memories, t.entity_memories)


@query(f"SELECT id, round(greatest(0.1, stability * 0.95), 4) AS stability FROM memories WHERE last_accessed_at < {TS} - INTERVAL 7 DAY OR (last_accessed_at IS NULL AND created_at < {TS} - INTERVAL 7 DAY)")
def stability_decay(t):
    return maintain.decayed(t.memories, AS_OF).select("id", F.round("stability", 4).alias("stability"))


@query(f"SELECT id FROM memories WHERE stability < 0.3 AND importance < 0.2 AND access_count = 0 AND category IS DISTINCT FROM '_archived' AND source_type NOT IN ('manual', 'synthesis', 'claude') AND created_at < {TS} - INTERVAL 30 DAY ORDER BY importance, stability, id LIMIT 50")
def archive_stale(t):
    return maintain.archivable(t.memories, AS_OF, 50).select("id")


@query(f"""SELECT id, old_tier, CASE rule WHEN 'pinned' THEN 0 WHEN 'promoted' THEN 1 ELSE 3 END AS new_tier, rule FROM (SELECT id, CAST(coalesce(tier, 2) AS BIGINT) AS old_tier,
 CASE WHEN importance >= 0.9 AND access_count >= 10 AND coalesce(tier, 2) <> 0 THEN 'pinned' WHEN coalesce(tier, 2) > 1 AND (coalesce(last_accessed_at >= {TS} - INTERVAL 7 DAY, FALSE) OR coalesce(quality_score >= 0.8, FALSE)) THEN 'promoted'
 WHEN coalesce(tier, 2) = 2 AND importance < 0.3 AND access_count < 3 AND created_at < {TS} - INTERVAL 30 DAY THEN 'demoted' END AS rule FROM memories) WHERE rule IS NOT NULL""")
def auto_tier(t):
    return maintain.tiers(t.memories, AS_OF)


@query("SELECT m.id, f.n, round(f.ratio, 4) AS ratio, round(least(1.0, greatest(0.0, m.importance + (f.ratio - 0.5) * 0.2)), 4) AS importance FROM memories m JOIN (SELECT memory_id, count(*) AS n, avg(CAST(was_useful AS DOUBLE)) AS ratio FROM memory_outcomes GROUP BY 1 HAVING count(*) >= 2) f ON f.memory_id = m.id")
def feedback_adjust(t):
    return maintain.feedback_adjusted(t.memories, t.memory_outcomes)


@query("SELECT doc_id AS id, round((greatest(1, least(5, doc_id % 7)) + greatest(1, least(5, doc_id % 6)) + greatest(1, least(5, doc_id % 9))) / 15.0, 4) AS quality FROM documents")
def quality_score(t):
    return t.raw("documents").select(F.col("doc_id").alias("id"), F.round(maintain.quality_of(F.col("doc_id") % 7, F.col("doc_id") % 6, F.col("doc_id") % 9), 4).alias("quality"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'moved' ELSE category END AS category FROM memories")
def partial_update(t):
    patch = t.memories.select("id", F.when(F.col("id") % 4 == 0, "moved").alias("category"))
    return maintain.patched(t.memories.select("id", "category"), patch, ["category"])


@query("SELECT memory_id, entity_id FROM entity_memories WHERE memory_id % 10 <> 3")
def cascade_delete(t):
    keys = t.memories.where("id % 10 = 3").select("id")
    return maintain.deleted({"links": (t.entity_memories, "memory_id")}, keys)["links"].select("memory_id", "entity_id")


VERS = "SELECT o_custkey AS id, o_orderkey AS seq, o_orderstatus AS flag, o_orderpriority AS status FROM orders"


@query(f"""SELECT id, seq AS line, flag, row_number() OVER (PARTITION BY id ORDER BY seq) - 1 AS version FROM (SELECT *, lag(flag) OVER w AS pf, lag(status) OVER w AS ps, lag(seq) OVER w AS pa FROM ({VERS}) WINDOW w AS (PARTITION BY id ORDER BY seq)) WHERE pa IS NULL OR flag IS DISTINCT FROM pf OR status IS DISTINCT FROM ps""")
def version_history(t):
    changes = t.raw("orders").selectExpr("o_custkey as id", "o_orderkey as at", "o_orderstatus as flag", "o_orderpriority as status")
    return maintain.versions(changes, ["flag", "status"]).select("id", F.col("at").alias("line"), "flag", "version")


@query("SELECT id, CASE WHEN id % 7 = 0 AND id % 5 <> 0 THEN 'DELETE' WHEN id % 5 = 0 AND id % 7 <> 0 THEN 'INSERT' ELSE 'UPDATE' END AS operation FROM entities WHERE (id % 7 = 0) <> (id % 5 = 0) OR (id % 3 = 0 AND id % 5 <> 0)")
def audit_diff(t):
    e = t.entities.select("id", "name")
    before = e.where("id % 5 <> 0 or id % 7 = 0")
    after = e.where("id % 7 <> 0 or id % 5 = 0").withColumn("name", F.when((F.col("id") % 3 == 0) & (F.col("id") % 5 != 0), F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return maintain.audit(before, after, ["name"]).select(F.col("row_id").alias("id"), "operation")


@query("""SELECT canonical_name, entity_type, CAST(sum(n) AS BIGINT) AS mention_count FROM (SELECT canonical_name, entity_type, CAST(mention_count AS BIGINT) AS n FROM entities UNION ALL SELECT lower(trim(s_name)), 'technology', 1 FROM supplier) GROUP BY 1, 2""")
def entity_upsert(t):
    mentions = t.raw("supplier").select(F.col("s_name").alias("name"), F.lit("technology").alias("entity_type"))
    return maintain.entity_upsert(t.entities, mentions).select("canonical_name", "entity_type", "mention_count")


@query("SELECT memory_id, entity_id, CASE WHEN memory_id % 2 = 0 THEN 0.25 ELSE round(confidence, 2) END AS confidence FROM entity_memories")
def link_upsert(t):
    new = t.entity_memories.where("memory_id % 2 = 0").withColumn("confidence", F.lit(0.25))
    return maintain.link_upsert(t.entity_memories, new).select("memory_id", "entity_id", F.round("confidence", 2).alias("confidence"))


@query("SELECT source_id, target_id, relationship_type, max(confidence) AS confidence FROM (SELECT source_id, target_id, relationship_type, confidence FROM entity_relations UNION ALL SELECT target_id, source_id, relationship_type, 0.95 FROM entity_relations) GROUP BY 1, 2, 3")
def relation_upsert(t):
    r = t.entity_relations
    new = r.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relationship_type", F.lit(0.95).alias("confidence"))
    return maintain.relation_upsert(r, new)


@query("SELECT CASE WHEN source_id % 5 = 1 THEN source_id - 1 ELSE source_id END AS source_id, CASE WHEN target_id % 5 = 1 THEN target_id - 1 ELSE target_id END AS target_id, relationship_type, min(id) AS id FROM entity_relations GROUP BY 1, 2, 3")
def entity_merge(t):
    mapping = t.entities.where("id % 5 = 1").select(F.col("id").alias("loser"), (F.col("id") - 1).alias("winner"))
    return maintain.merged_entities(t.entity_relations, mapping).select("source_id", "target_id", "relationship_type", "id")


@query("SELECT id, CASE category WHEN 'data' THEN 'storage' WHEN 'backend' THEN 'server' ELSE category END AS category FROM memories")
def category_rewrite(t):
    return maintain.categories_replaced(t.memories, {"data": "storage", "backend": "server"}).select("id", "category")


@query("SELECT doc_id AS id, array_to_string(CASE WHEN doc_id IN (1, 2) THEN [lang, 'handoff:completed'] ELSE [lang, 'handoff:in_progress'] END, ',') AS tags FROM documents")
def handoff_resolve(t):
    open_ = t.raw("documents").select(F.col("doc_id").alias("id"), F.array("lang", F.lit("handoff:in_progress")).alias("tags"))
    return maintain.handoff_resolved(open_, [1, 2], "completed").select("id", F.array_join("tags", ",").alias("tags"))


# --- graph ---

SYM = "SELECT id, source_id AS u, target_id AS v FROM entity_relations WHERE valid UNION ALL SELECT id, target_id, source_id FROM entity_relations WHERE valid"


@query(f"SELECT edge_id, min(depth) AS depth FROM (SELECT id AS edge_id, 1 AS depth FROM ({SYM}) WHERE u = 1 UNION ALL SELECT b.id, 2 FROM ({SYM}) a JOIN ({SYM}) b ON b.u = a.v WHERE a.u = 1) GROUP BY 1")
def entity_bfs_depth2(t):
    start = t.spark.createDataFrame([(1,)], "id long")
    return graph.neighbourhood(t.entity_relations, start, 2).select("edge_id", "depth")


def relation_pairs(t: Tables) -> DataFrame:
    return t.entity_relations.where("valid").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))


def component_sql(sizes: bool) -> str:
    reach = f"WITH RECURSIVE s AS ({SYM}), r(node, reached) AS (SELECT u, u FROM s UNION SELECT r.node, s.v FROM r JOIN s ON s.u = r.reached) SELECT node, min(reached) AS component FROM r WHERE node IN (SELECT u FROM s WHERE u <> v) GROUP BY 1"
    return f"SELECT component, count(*) AS members FROM ({reach}) GROUP BY 1" if sizes else f"SELECT node, component FROM ({reach})"


@query(component_sql(False))
def connected_components(t):
    return graph.components(relation_pairs(t))


@query(component_sql(True))
def component_sizes(t):
    return graph.components(relation_pairs(t)).groupBy("component").agg(F.count("*").alias("members"))


@query()
def communities(t):
    return graph.communities(t.entity_relations)


@query(f"SELECT u AS id, count(*) AS degree FROM ({SYM}) GROUP BY 1")
def degrees(t):
    return graph.degrees(t.entity_relations)


@query("SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, round(sum(CASE WHEN coalesce(confidence, 0) = 0 THEN 1.0 ELSE confidence END), 4) AS w FROM entity_relations WHERE valid AND source_id <> target_id GROUP BY 1, 2")
def edge_weights(t):
    return graph.weights(t.entity_relations).select("a", "b", F.round("w", 4).alias("w"))


# --- text and sequences ---


@query("SELECT doc_id AS id, regexp_matches(text, '(?i)(reveal|show|print|repeat) (me )?(your|the) (system )?(prompt|instructions)') AS flagged FROM documents")
def injection_flags(t):
    return t.raw("documents").select(F.col("doc_id").alias("id"), T.injection(F.col("text")).alias("flagged"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<\\?.*?\\?>', ' ', 'gs'), '<script\\b.*?</script>', ' ', 'gis'), '<style\\b.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\n\\f\\r\\v]+', ' ', 'g')) AS content FROM pages")
def html_strip(t):
    return t.raw("pages").select("page_id", T.html_text(F.col("html")).alias("content"))


@query("SELECT p_partkey AS id, p_name AS name, (length(p_name) <= 2 OR regexp_matches(lower(p_name), '^[a-z]+ (color|size|name|value|button)$')) AS noise FROM part")
def noise_names(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), T.is_noise(F.col("p_name")).alias("noise"))


@query("SELECT id, CASE WHEN category = '_archived' THEN '_archived' ELSE category END AS category FROM memories WHERE category IS NOT NULL")
def category_normalize(t):
    return t.memories.where("category is not null").select("id", T.category_of(F.col("category")).alias("category"))


def chunks_sql(rows: str, most: int = 6000, overlap: int = 500) -> str:
    """SQL of (id, chunk_index, chunk_total, chunk_offset, chunk) over ``rows`` (id, content): the chunk rule as a recursion over places."""
    before = lambda mark: f"length(regexp_extract(substr(text, pos + 1, {most}), '(?s)^(.*){mark}', 1))"
    cases = " ".join(f"WHEN {before(mark)} > {most // 3} THEN pos + {before(mark)} + {kept}" for mark, kept in (("\\n\\n", 0), ("\\n", 0), ("\\. ", 2), ("! ", 2), ("\\? ", 2)))
    end = f"CASE WHEN pos + {most} >= length(text) THEN length(text) {cases} ELSE pos + {most} END"
    trimmed = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"""SELECT id, row_number() OVER (PARTITION BY id ORDER BY chunk_offset) - 1 AS chunk_index, count(*) OVER (PARTITION BY id) AS chunk_total, chunk_offset, chunk FROM (
 WITH RECURSIVE t AS (SELECT id, {trimmed('content')} AS text FROM ({rows})), c AS (
  SELECT id, text, pos, {end} AS fin FROM (SELECT id, text, 0 AS pos FROM t WHERE length(text) > {most})
  UNION ALL SELECT id, text, pos, {end} FROM (SELECT id, text, CASE WHEN fin - {overlap} > pos THEN fin - {overlap} ELSE fin END AS pos FROM c) WHERE pos < length(text))
 SELECT id, pos AS chunk_offset, {trimmed('substr(text, pos + 1, fin - pos)')} AS chunk FROM c UNION ALL SELECT id, 0, text FROM t WHERE length(text) <= {most}) WHERE chunk <> ''"""


@query(chunks_sql("SELECT id, content FROM memories"))
def chunk_text(t):
    return T.chunked(t.memories)


@query("SELECT id, concat_ws('. ', category, array_to_string(tags, ', '), content) AS input FROM memories")
def embedding_inputs(t):
    return t.memories.select("id", T.embedding_input(F.lit(None).cast("string"), F.col("category"), F.col("tags"), F.col("content")).alias("input"))


SPOKEN = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL"


@query(f"SELECT conv_id, CAST(w.k AS INTEGER) AS window, min(turn) AS first_turn, count(*) AS n FROM ({SPOKEN}) s JOIN (SELECT unnest(range(0, 1000)) AS k) w ON s.p >= 6 * w.k AND s.p < 6 * w.k + 8 WHERE n_turns >= 3 GROUP BY 1, 2")
def sliding_windows(t):
    return windows.message_windows(t.raw("conversations")).select("conv_id", "window", "first_turn", "n")


CHECKS = "SELECT event_id AS id, user_id AS key, ts, event_type <> 'error' AS healthy FROM events"


@query(f"""SELECT key, id, run FROM (SELECT *, row_number() OVER (PARTITION BY key, island ORDER BY ts, id) AS run FROM (SELECT *, sum(CASE WHEN healthy THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM ({CHECKS})) WHERE NOT healthy) WHERE run = 2""")
def consecutive_unhealthy(t):
    checks = t.raw("events").selectExpr("event_id as id", "user_id as key", "ts as at", "event_type <> 'error' as healthy")
    return windows.consecutive(checks, 2)


@query("SELECT id, key, recent FROM (SELECT event_id AS id, user_id AS key, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 3")
def rate_limit_log(t):
    requests = t.raw("events").selectExpr("event_id as id", "user_id as key", "ts as at")
    return windows.over_limit(requests, 6 * 3600, 3)


@query("SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 150)")
def missing_keys(t):
    e = t.raw("events").withColumnRenamed("user_id", "key")
    return windows.missing(e.where("event_type = 'view'"), e.where("event_type = 'click' and value > 150"))


@query("SELECT topic, created_us, rn FROM (SELECT topic, epoch_us(created_at) AS created_us, row_number() OVER (PARTITION BY topic ORDER BY created_at DESC, strength DESC) AS rn FROM interest_signals) WHERE rn <= 3")
def last_n_per_key(t):
    w = Window.partitionBy("topic").orderBy(F.desc("created_at"), F.desc("strength"))
    return t.interest_signals.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("topic", F.unix_micros("created_at").alias("created_us"), F.col("rn").cast("long").alias("rn"))
