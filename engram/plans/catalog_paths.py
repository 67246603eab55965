"""Write path, bounded traversal, community answers, and filters with all their conditions, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, graph, jobs, joins, retrieval, stats
from ..sources import sitemaps
from . import providers
from .catalog import TS, query
from .fixtures import AS_OF

SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
#: New rows are those of identifiers divisible by three; the judge is a rule that SQL can state, with every kind of faulty answer.
CANDIDATES = f"(SELECT * FROM (SELECT b.vec_id AS id, a.vec_id AS old_id, {SIM} AS s, row_number() OVER (PARTITION BY b.vec_id ORDER BY {SIM} DESC, a.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id % 3 <> 0 AND b.vec_id % 3 = 0 WHERE {SIM} >= 0.25) WHERE place <= 5)"
DECIDED = f"""(SELECT d.doc_id AS id, CASE WHEN c.n IS NULL THEN 'ADD' ELSE CASE d.doc_id % 6 WHEN 0 THEN 'UPDATE' WHEN 3 THEN CASE WHEN d.doc_id % 4 = 1 THEN 'NOOP' WHEN d.doc_id % 4 = 3 THEN 'SUPERSEDE' END END END AS action,
 CASE WHEN d.doc_id % 5 = 0 THEN c.second ELSE c.first END AS target, CASE WHEN d.doc_id % 2 = 0 AND d.doc_id % 7 <> 0 THEN 'merged ' || d.doc_id ELSE d.text END AS content, d.lang, d.source
 FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN (SELECT id, count(*) AS n, max(old_id) FILTER (WHERE place = 1) AS first, coalesce(max(old_id) FILTER (WHERE place = 2), max(old_id) FILTER (WHERE place = 1)) AS second FROM {CANDIDATES} GROUP BY id) c ON c.id = d.doc_id WHERE d.doc_id % 3 = 0)"""


def judge(rows):
    i = F.col("id")
    action = F.when(i % 6 == 0, "update").when(i % 4 == 1, "NOOP").when(i % 4 == 3, "supersede")
    target = F.when((i % 5 == 0) & (F.size("candidates") > 1), F.col("candidates")[1]["old_id"]).otherwise(F.lit(-1))  # of most rows, an identifier that is no candidate's
    return rows.withColumn("answer", F.struct(action.alias("action"), target.alias("target_id"), F.when((i % 2 == 0) & (i % 7 != 0), F.concat(F.lit("merged "), i)).otherwise("  ").alias("content")))


def decisions(t):
    rows = t.raw("documents").join(t.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"), F.col("source").alias("category"), "embedding")
    pairs = joins.similar_pairs(t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.25)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).where("a % 3 <> 0 and b % 3 = 0")
    new, stored = rows.where("id % 3 = 0"), rows.where("id % 3 <> 0")
    return stored, new, providers.decided(new, providers.write_candidates(both.select(F.col("b").alias("new_id"), F.col("a").alias("old_id"), "similarity"), 0.25), judge)


@query(f"SELECT id, coalesce(action, 'ADD') AS action, CASE WHEN action IN ('UPDATE', 'SUPERSEDE') THEN target END AS target_id, CASE WHEN action IN ('UPDATE', 'SUPERSEDE') THEN content ELSE (SELECT text FROM documents WHERE doc_id = id) END AS content FROM {DECIDED}")
def write_path_decisions(t):
    """Every action, with targets that are no candidates and contents that are empty."""
    return decisions(t)[2]


@query(f"""SELECT d.doc_id AS id, coalesce(u.content, d.text) AS content, CASE WHEN g.target IS NOT NULL THEN '_archived' ELSE coalesce(u.source, d.source) END AS category, coalesce(u.lang, d.lang) AS lang, CASE WHEN g.target IS NOT NULL THEN 'superseded' END AS archived_reason
 FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN (SELECT target, arg_max(content, id) AS content, arg_max(lang, id) AS lang, arg_max(source, id) AS source FROM {DECIDED} WHERE action = 'UPDATE' GROUP BY 1) u ON u.target = d.doc_id
 LEFT JOIN (SELECT DISTINCT target FROM {DECIDED} WHERE action = 'SUPERSEDE') g ON g.target = d.doc_id WHERE d.doc_id % 3 <> 0""")
def write_path_stored(t):
    """The stored rows after the whole write path."""
    stored, new, said = decisions(t)
    return providers.written_back(stored, new, said)["stored"].select("id", "content", "category", F.col("tags")[0].alias("lang"), "archived_reason")


@query(f"SELECT id, CASE WHEN action = 'SUPERSEDE' THEN target END AS supersedes FROM {DECIDED} WHERE coalesce(action, 'ADD') IN ('ADD', 'SUPERSEDE')")
def write_path_inserted(t):
    return providers.written_back(*decisions(t))["inserted"].select("id", "supersedes")


EDGES = "(SELECT DISTINCT u, v FROM (SELECT source_id AS u, target_id AS v FROM entity_relations WHERE valid UNION ALL SELECT target_id, source_id FROM entity_relations WHERE valid) WHERE u <> v)"


@query(f"""SELECT * FROM (WITH one AS (SELECT * FROM (SELECT u AS start, v AS id, row_number() OVER (PARTITION BY u ORDER BY v) AS n FROM {EDGES} WHERE u % 10 = 0) WHERE n <= 20),
 two AS (SELECT start, id, row_number() OVER (PARTITION BY start ORDER BY id) AS n FROM (SELECT DISTINCT one.start, e.v AS id FROM one JOIN {EDGES} e ON e.u = one.id WHERE e.v <> one.start AND (one.start, e.v) NOT IN (SELECT (start, id) FROM one)))
 SELECT s_suppkey AS start, s_suppkey AS id, 0 AS depth FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT start, id, 1 FROM one UNION ALL SELECT start, id, 2 FROM two WHERE n <= 20 - (SELECT count(*) FROM one WHERE one.start = two.start))""")
def bounded_neighbourhoods(t):
    """Twenty nodes around each of many starts, over dense edges: every start fills up."""
    starts = t.raw("supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("start"), F.col("s_suppkey").alias("id"))
    return graph.bounded_neighbourhoods(t.entity_relations, starts, 2, 20)


def nation_communities(t):
    names = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"])
    grouped = t.raw("supplier").groupBy("s_nationkey").agg(names.alias("names"), F.count("*").alias("size"))
    return grouped.join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").cast("long").alias("community"), F.col("n_name").alias("title"), F.when(F.col("s_nationkey") % 7 != 6, F.concat(F.lit("suppliers of "), "n_name")).alias("summary"), F.array(F.lit("supply"), F.concat(F.lit("region "), "n_regionkey")).alias("topics"), "names", "size")


def rated(rows):
    c = F.col("community")
    return rows.withColumn("answer", F.when(c % 11 != 10, F.struct((c % 4 != 3).alias("relevant"), ((c * 7) % 10 / 10).alias("score"), F.array(F.concat(F.lit("has "), "size")).alias("key_points"))))


@query("""SELECT string_agg('**' || title || '** (relevance: ' || printf('%.1f', score) || ', ' || size || ' entities)' || chr(10) || '  Summary: suppliers of ' || title || chr(10) || '  Topics: supply, region ' || region || chr(10) || '  Key entities: ' || names || chr(10) || '  - has ' || size, chr(10) || chr(10) ORDER BY score DESC, community) AS answer FROM (
 SELECT n_nationkey AS community, n_name AS title, n_regionkey AS region, ((n_nationkey * 7) % 10) / 10.0::DOUBLE AS score, count(*) AS size, array_to_string(list(s_name ORDER BY s_suppkey)[1:5], ', ') AS names FROM supplier JOIN nation ON n_nationkey = s_nationkey
 WHERE n_nationkey % 7 <> 6 AND n_nationkey % 11 <> 10 AND n_nationkey % 4 <> 3 AND ((n_nationkey * 7) % 10) / 10.0::DOUBLE >= 0.3 GROUP BY 1, 2, 3, 4 ORDER BY score DESC, community LIMIT 10) HAVING count(*) > 0""")
def global_answer(t):
    """Communities judged one by one, the ten best of 0.3 or more, and an answer over their context; here the context itself."""
    return retrieval.global_answer("who supplies?", retrieval.relevant_communities(nation_communities(t), rated), lambda rows: rows.select(F.col("context").alias("answer")))


@query("SELECT conv_id, count(*) AS messages FROM conversations WHERE conv_id % 4 IN (0, 1) AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 5 = 0) GROUP BY 1 HAVING count(*) >= 3 AND sum(length(text)) >= 200")
def undistilled_sources(t):
    """Undistilled conversations of two sources, without those that a marker names."""
    c = t.raw("conversations").withColumn("source_type", F.element_at(F.array(F.lit("chatgpt"), F.lit("claude"), F.lit("agent"), F.lit("crawl")), (F.col("conv_id") % 4 + 1).cast("int")))
    return filters.undistilled(c, ["chatgpt", "claude"], c.where("conv_id % 5 = 0").select("conv_id"))


@query("SELECT page_id AS id, url FROM pages WHERE page_id % 3 <> 0 ORDER BY page_id % 10, page_id LIMIT 25")
def queue_waiting(t):
    p = t.raw("pages").select(F.col("page_id").alias("id"), "url", F.when(F.col("page_id") % 3 == 0, F.lit(AS_OF).cast("timestamp")).alias("crawled_at"), (F.lit(AS_OF).cast("timestamp") + F.make_dt_interval((F.col("page_id") % 10).cast("int"))).alias("queued_at"))
    return filters.waiting(p, 25).select("id", "url")


@query(f"SELECT domain, count(*) AS n, round(avg(CAST(novel AS DOUBLE)), 4) AS novelty, count(*) >= 3 AND avg(CAST(novel AS DOUBLE)) < 0.4 AS saturated FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id DESC) AS rn FROM agent_events WHERE domain IS NOT NULL AND created_at >= {TS} - INTERVAL 168 HOUR) WHERE rn <= 20 GROUP BY 1")
def domain_saturation_week(t):
    """Saturation by the outcomes of the last seven days only."""
    return stats.domain_saturation(t.agent_events, novelty=0.4, as_of=AS_OF).select("domain", "n", F.round("novelty", 4).alias("novelty"), "saturated")


@query("SELECT e.id, e.name, count(DISTINCT m.source_machine) AS machines, count(*) AS n FROM entities e JOIN entity_memories l ON l.entity_id = e.id JOIN memories m ON m.id = l.memory_id WHERE e.id % 4 <> 1 GROUP BY 1, 2 HAVING count(DISTINCT m.source_machine) >= 2")
def cross_machine_cooled(t):
    """Entities of several machines, but for those with a recent marker."""
    return joins.cross_machine(t.entities, t.entity_memories, t.memories, cooling=t.entities.where("id % 4 = 1").select("id")).select("id", "name", "machines", "n")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN id % 4 ELSE tier END AS tier FROM memories")
def tier_update(t):
    return filters.tier_set(t.memories.select("id", "tier"), t.memories.where("id % 3 = 0").select("id", (F.col("id") % 4).alias("tier"))).select("id", "tier")


PAIRED = """(SELECT a.id AS a, b.id AS b, a.id % 3 <> 2 AS yes, CASE WHEN a.id % 8 = 0 THEN ' Best ' || a.id || ' ' END AS new_name, CASE WHEN a.id % 6 = 0 THEN 'concept' END AS new_type, coalesce(x.n, 0) >= coalesce(y.n, 0) AS a_wins
 FROM entities a JOIN entities b ON b.id = a.id + 1 AND a.id % 2 = 0 LEFT JOIN (SELECT entity_id, count(DISTINCT memory_id) AS n FROM entity_memories GROUP BY 1) x ON x.entity_id = a.id LEFT JOIN (SELECT entity_id, count(DISTINCT memory_id) AS n FROM entity_memories GROUP BY 1) y ON y.entity_id = b.id WHERE a.id % 10 <> 4)"""


def merging(t):
    """Neighbours by number as pairs; the judge is a rule that fails on some, and names and types some winners anew."""
    e = t.entities
    pairs = e.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.9).alias("similarity"))
    a = F.col("a")
    judge_ = lambda rows: rows.withColumns({"should_merge": F.when(a % 10 != 4, a % 3 != 2), "winner_name": F.when(a % 8 == 0, F.concat(F.lit(" Best "), a, F.lit(" "))), "winner_type": F.when(a % 6 == 0, "concept")})
    return jobs.entity_merging(pairs, e, t.entity_memories, judge_)


@query(f"SELECT CASE WHEN a_wins THEN b ELSE a END AS loser, CASE WHEN a_wins THEN a ELSE b END AS winner FROM {PAIRED} WHERE yes")
def entity_merges(t):
    return merging(t)["merges"]


@query(f"SELECT e.id, coalesce(new_name, e.name) AS name, coalesce(lower(trim(new_name)), e.canonical_name) AS canonical_name, coalesce(new_type, e.entity_type) AS entity_type FROM {PAIRED} p JOIN entities e ON e.id = CASE WHEN a_wins THEN a ELSE b END WHERE yes")
def entity_merge_winners(t):
    return merging(t)["entities"]


@query(f"SELECT a, b FROM {PAIRED} WHERE NOT yes")
def entity_merge_checked(t):
    return merging(t)["checked"]


PATH = "(CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) END)"


@query(f"""SELECT page_id, url, coalesce(CASE WHEN {PATH} LIKE '/fr/%?page=2%' THEN true WHEN {PATH} LIKE '/%.html' THEN false WHEN {PATH} LIKE '/en/4%' THEN true WHEN {PATH} LIKE '/en/%' THEN false
 WHEN regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) LIKE 'm.%' THEN false END, true) AS allowed FROM pages WHERE url IS NOT NULL""")
def crawl_allowed(t):
    """Pages under robots rules of every host: the longest pattern counts."""
    p = t.raw("pages").where("url is not null").select("page_id", "url")
    hosts = p.select(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)).alias("host")).distinct()
    text = F.concat(F.lit("User-agent: *\nDisallow: /en/\nAllow: /en/4\nDisallow: /*.html$\nAllow: /fr/*?page=2\n"), F.when(F.col("host").startswith("m."), "Disallow: /\n").otherwise(""))
    return sitemaps.allowed(p, sitemaps.robots_rules(hosts.withColumn("text", text)))
