"""The engine's tables, derived from the supplied ones: as DataFrames, and as DuckDB common table expressions.

All times are relative to ``AS_OF``; nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"


def names(values: list[str], index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} as int) + 1)"


SOURCE_TYPES = ["manual", "chatgpt", "claude", "agent", "crawl", "synthesis"]
CATEGORIES = ["debugging", "architecture", "data", "backend", "patterns"]
ENTITY_TYPES = ["technology", "project", "concept", "organization", "person"]
RELATION_TYPES = ["uses", "depends_on", "part_of", "runs_on", "replaces"]


class Tables:
    """Lazy views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # Times without a zone are read as of the session's, which is UTC.
        return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})

    @property
    def memories(self) -> DataFrame:
        joined = self.raw("documents").join(self.raw("labels"), "doc_id", "left").join(self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").withColumn("id", F.col("doc_id"))
        return joined.selectExpr(
            "id", "text as content", "case when id % 3 = 0 then null else left(text, 80) end as summary", "embedding",
            "case id % 10 when 0 then null when 1 then 'old' else 'current' end as embedding_model",
            names(SOURCE_TYPES, "id % 6") + " as source_type", "case when id % 11 = 0 then null else concat('m', id % 5) end as source_machine",
            "array(lang, source) as tags",
            f"case when id % 13 = 0 then null when id % 17 = 0 then '_archived' else {names(CATEGORIES, 'id % 5')} end as category",
            "0.5D + (id % 6) / 10D as confidence", f"timestamp'{AS_OF}' - make_dt_interval(cast(id % 120 as int)) as created_at",
            f"case when id % 4 = 0 then null else timestamp'{AS_OF}' - make_dt_interval(cast((id % 120) div 2 as int)) end as last_accessed_at",
            "case when id % 4 = 0 then 0L else id % 15 end as access_count", "(id % 100) / 100D as stability", "((id * 7) % 50) / 50D as importance",
            "0.3D + 0.5D * quality as quality_score", "case when id % 19 = 0 then null else id % 4 end as tier",
            "element_at(array(null, 'failed', 'pending', 'done', 'done'), cast(id % 5 as int) + 1) as extraction_status",
            "id div 5 as document_id", "id % 5 as chunk_index", "5L as chunk_total",
        )

    def _links(self, entity: str) -> DataFrame:
        """Links of all lineitem rows: order keys are dealt onto documents by modulo."""
        n = self.raw("documents").agg(F.count("*").alias("n_docs"))
        return self.raw("lineitem").join(F.broadcast(n), F.col("n_docs") > 0).selectExpr("l_orderkey % n_docs as memory_id", f"{entity} as entity_id", "l_discount")

    @property
    def entity_memories(self) -> DataFrame:
        return self._links("l_suppkey").groupBy("memory_id", "entity_id").agg(F.round(F.max(1 - F.col("l_discount")), 2).alias("confidence")).withColumn("role", F.lit("mention"))

    @property
    def entities(self) -> DataFrame:
        links = self.entity_memories.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mention_count"))
        return self.raw("supplier").withColumn("id", F.col("s_suppkey")).join(links, "id", "left").selectExpr(
            "id", "s_name as name", "lower(trim(s_name)) as canonical_name", names(ENTITY_TYPES, "s_nationkey % 5") + " as entity_type",
            "case when id % 3 = 0 then null else concat('about ', s_name) end as description", "coalesce(mention_count, 0L) as mention_count",
            f"timestamp'{AS_OF}' - make_dt_interval(cast(id % 40 as int)) as created_at",
        )

    @property
    def part_entities(self) -> DataFrame:
        return self.raw("part").selectExpr("p_partkey as id", "p_name as name", "lower(trim(p_name)) as canonical_name", "p_type as entity_type", "p_size as mention_count")

    @property
    def part_links(self) -> DataFrame:
        return self._links("l_partkey").select("memory_id", "entity_id").distinct()

    @property
    def entity_relations(self) -> DataFrame:
        n = self.raw("supplier").agg(F.count("*").alias("n_supp"))
        rows = self.raw("lineitem").join(F.broadcast(n), F.col("n_supp") > 0).selectExpr("l_suppkey as source_id", "(l_partkey * 7) % n_supp as target_id", names(RELATION_TYPES, "l_partkey % 5") + " as relationship_type", "(l_suppkey * n_supp + (l_partkey * 7) % n_supp) * 5 + l_partkey % 5 as id", "l_discount", "l_tax")
        # The identifier is computed from source, target and type, so that no task numbers all rows.
        return rows.groupBy("source_id", "target_id", "relationship_type", "id").agg(F.round(F.max(1 - F.col("l_discount")), 2).alias("confidence"), (F.min("l_tax") < 0.07).alias("valid"))

    @property
    def agent_events(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id as id", "ts as created_at", "user_id", "value",
            "case event_type when 'error' then 'error' when 'purchase' then 'task_complete' when 'signup' then 'decision' when 'view' then 'insight_processed' else 'crawl_outcome' end as event_type",
            "case when event_type = 'view' then cast(get_json_object(props, '$.k') as long) end as source_event_id",
            "case when event_type = 'click' then concat('d', user_id % 10) end as domain", "case when event_type = 'click' then value > 150 end as novel",
        )

    @property
    def memory_outcomes(self) -> DataFrame:
        return self.raw("events").selectExpr("user_id as memory_id", "value > 100 as was_useful", "ts as created_at")

    @property
    def interest_signals(self) -> DataFrame:
        return self.raw("events").selectExpr("concat(event_type, '-', user_id % 10) as topic", "value / 100 as strength", "ts as created_at")


def _pick(values: list[str], index: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({index} AS BIGINT) + 1)"


#: The same tables for DuckDB.
CTE = {
    "memories": f"""SELECT d.doc_id AS id, d.text AS content, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE left(d.text, 80) END AS summary, e.embedding AS embedding,
  CASE d.doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'old' ELSE 'current' END AS embedding_model, {_pick(SOURCE_TYPES, 'd.doc_id % 6')} AS source_type,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE 'm' || (d.doc_id % 5) END AS source_machine, [d.lang, d.source] AS tags,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL WHEN d.doc_id % 17 = 0 THEN '_archived' ELSE {_pick(CATEGORIES, 'd.doc_id % 5')} END AS category,
  CAST(0.5 AS DOUBLE) + CAST(d.doc_id % 6 AS DOUBLE) / 10 AS confidence, TIMESTAMP '{AS_OF}' - to_days(CAST(d.doc_id % 120 AS INTEGER)) AS created_at,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE TIMESTAMP '{AS_OF}' - to_days(CAST((d.doc_id % 120) // 2 AS INTEGER)) END AS last_accessed_at,
  CASE WHEN d.doc_id % 4 = 0 THEN 0 ELSE d.doc_id % 15 END AS access_count, CAST(d.doc_id % 100 AS DOUBLE) / 100 AS stability, CAST((d.doc_id * 7) % 50 AS DOUBLE) / 50 AS importance,
  CAST(0.3 AS DOUBLE) + CAST(0.5 AS DOUBLE) * l.quality AS quality_score, CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE d.doc_id % 4 END AS tier,
  list_extract([NULL, 'failed', 'pending', 'done', 'done'], CAST(d.doc_id % 5 AS BIGINT) + 1) AS extraction_status, d.doc_id // 5 AS document_id, d.doc_id % 5 AS chunk_index, 5 AS chunk_total
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "entity_memories": "SELECT l_orderkey % (SELECT count(*) FROM documents) AS memory_id, l_suppkey AS entity_id, round(max(1 - l_discount), 2) AS confidence, 'mention' AS role FROM lineitem GROUP BY 1, 2",
    "entities": f"""SELECT s_suppkey AS id, s_name AS name, lower(trim(s_name)) AS canonical_name, {_pick(ENTITY_TYPES, 's_nationkey % 5')} AS entity_type, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'about ' || s_name END AS description,
  coalesce(c.n, 0) AS mention_count, TIMESTAMP '{AS_OF}' - to_days(CAST(s_suppkey % 40 AS INTEGER)) AS created_at FROM supplier LEFT JOIN (SELECT entity_id, count(*) AS n FROM entity_memories GROUP BY 1) c ON c.entity_id = s_suppkey""",
    "part_entities": "SELECT p_partkey AS id, p_name AS name, lower(trim(p_name)) AS canonical_name, p_type AS entity_type, p_size AS mention_count FROM part",
    "part_links": "SELECT DISTINCT l_orderkey % (SELECT count(*) FROM documents) AS memory_id, l_partkey AS entity_id FROM lineitem",
    "entity_relations": f"""SELECT source_id, target_id, relationship_type, round(max(1 - l_discount), 2) AS confidence, min(l_tax) < 0.07 AS valid, (source_id * n + target_id) * 5 + kind AS id FROM (SELECT l_suppkey AS source_id, (l_partkey * 7) % n AS target_id, l_partkey % 5 AS kind,
  {_pick(RELATION_TYPES, 'l_partkey % 5')} AS relationship_type, l_discount, l_tax, n FROM lineitem, (SELECT count(*) AS n FROM supplier)) GROUP BY source_id, target_id, relationship_type, kind, n""",
    "agent_events": """SELECT event_id AS id, ts AS created_at, user_id, value, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'task_complete' WHEN 'signup' THEN 'decision' WHEN 'view' THEN 'insight_processed' ELSE 'crawl_outcome' END AS event_type,
  CASE WHEN event_type = 'view' THEN CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) END AS source_event_id, CASE WHEN event_type = 'click' THEN 'd' || (user_id % 10) END AS domain, CASE WHEN event_type = 'click' THEN value > 150 END AS novel FROM events""",
    "memory_outcomes": "SELECT user_id AS memory_id, value > 100 AS was_useful, ts AS created_at FROM events",
    "interest_signals": "SELECT event_type || '-' || (user_id % 10) AS topic, value / 100 AS strength, ts AS created_at FROM events",
}
NEEDS = {"entities": ["entity_memories"]}


def with_tables(sql: str) -> str:
    """A DuckDB query with the tables that it names put before it."""
    import re

    used: list[str] = []

    def need(text: str) -> None:
        for name in CTE:
            if re.search(rf"\b{name}\b", text) and name not in used:
                for x in NEEDS.get(name, []):
                    if x not in used:
                        used.append(x)
                used.append(name)

    need(sql)
    return ("WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in used) + " " if used else "") + sql
