"""Queries over the library's own indexes: vectors in cells, words with positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from .catalog import COS, REL, WORDS, query, query_vector
from .catalog import NEAR as NEAREST
from .fixtures import AS_OF

PAYLOAD = ["importance", "tier", "quality_score", "created_at"]


def vectors(t) -> VectorIndex:
    return VectorIndex.build(t.memories.select("id", "embedding", "embedding_model", *PAYLOAD))


def texts(t) -> TextIndex:
    return TextIndex.build(t.memories.select("id", "content", *PAYLOAD), payload=PAYLOAD)


WARM = "(embedding_model is null or embedding_model = 'current') and tier < 3"


@query(f"SELECT id, round(sim, 4) AS similarity, round({REL}, 4) AS relevance FROM (SELECT *, {COS} AS sim FROM memories WHERE embedding IS NOT NULL AND (embedding_model IS NULL OR embedding_model = 'current') AND tier < 3 AND {COS} >= 0.10 ORDER BY sim DESC, id LIMIT 30) ORDER BY {REL} DESC, id LIMIT 10")
def indexed_relevance(t):
    """Vector search through the index, the search proven exact."""
    q = query_vector(t)
    near = vectors(t).near(q, 30, exact=True, only=F.expr(WARM))
    return retrieval.vector_search(near, q, 10, 0.10, AS_OF).select("id", F.round("similarity", 4).alias("similarity"), F.round("relevance", 4).alias("relevance"))


@query(f"SELECT id, round({COS}, 4) AS similarity FROM memories WHERE embedding IS NOT NULL AND id % 3 <> 0 AND {COS} IS NOT NULL ORDER BY {COS} DESC, id LIMIT 25")
def index_after_changes(t):
    """The index after a deletion and an insertion that replaces rows: a third is deleted, a ninth of all comes twice."""
    index = vectors(t)
    m = t.memories.select("id", "embedding", "embedding_model", *PAYLOAD)
    index.delete(m.where("id % 3 = 0").select("id"))
    index.insert(m.where("id % 9 = 1"))
    q = query_vector(t)
    return retrieval.scored(index.near(q, 25, exact=True), q, include_cold=True, model=None).orderBy(F.desc("similarity"), "id").limit(25).select("id", F.round("similarity", 4).alias("similarity"))


def stems_sql(**forms: str) -> str:
    """(id, term, pos) of the words that have one of the named stems; the forms are all that the supplied tables hold."""
    cases = " ".join(f"WHEN regexp_full_match(word, '{form}') THEN '{term}'" for term, form in forms.items())
    return f"(SELECT id, CASE {cases} END AS term, pos FROM (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS words FROM memories)) WHERE term IS NOT NULL)"


ATTION, THTION = "attion(s|ed|ing|es|er|ou)?", "thtion(s|ed|ing|es)?"
NEAR = f"""SELECT a.id, 1 - exp(sum(ln(1 - CASE WHEN abs(a.pos - b.pos) <= 100 THEN sqrt(0.01 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2))) ELSE 0 END))) AS rank_score
 FROM {stems_sql(attion=ATTION, thtion=THTION)} a JOIN {stems_sql(attion=ATTION, thtion=THTION)} b ON a.id = b.id AND a.term = 'attion' AND b.term = 'thtion' GROUP BY a.id"""


@query(f"SELECT id, round(greatest(rank_score, 1e-20), 6) AS rank_score FROM ({NEAR})")
def indexed_text(t):
    """All texts with the stems of both words, ranked by how near they stand."""
    return texts(t).matches("the attions of thtioned").select("id", F.round("rank_score", 6).alias("rank_score"))


@query(f"""SELECT id, round(sum(part) / 3, 6) AS rank_score FROM (SELECT id, term, 0.1 * sum(1.0 / (n * n)) / 1.64493406685 AS part FROM (
 SELECT id, term, row_number() OVER (PARTITION BY id, term ORDER BY pos) AS n FROM {stems_sql(en='en(ed|es|ing|s)?', er='er(ed|es|ing|s)?', attion=ATTION)}) GROUP BY id, term)
 WHERE (id IN (SELECT x.id FROM {stems_sql(en='en(ed|es|ing|s)?', er='er(ed|es|ing|s)?')} x JOIN {stems_sql(en='en(ed|es|ing|s)?', er='er(ed|es|ing|s)?')} y ON x.id = y.id AND x.term = 'en' AND y.term = 'er' AND y.pos = x.pos + 1)
  OR id IN (SELECT id FROM {stems_sql(attion=ATTION)})) AND id NOT IN (SELECT id FROM {stems_sql(thtion=THTION)}) GROUP BY id""")
def indexed_syntax(t):
    """A phrase or a word, without another, by the inverted index."""
    return texts(t).matches('"en er" or attion -thtion').select("id", F.round("rank_score", 6).alias("rank_score"))


@query(f"""SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS lists FROM (
 SELECT id, row_number() OVER (ORDER BY {REL} DESC, id) AS rank FROM (SELECT *, {COS} AS sim FROM memories WHERE embedding IS NOT NULL AND (embedding_model IS NULL OR embedding_model = 'current') AND tier < 3 AND {COS} >= 0.10 ORDER BY sim DESC, id LIMIT 90) QUALIFY rank <= 30
 UNION ALL SELECT id, rank FROM (SELECT m.id, row_number() OVER (ORDER BY round(greatest(rank_score, 1e-20), 12) DESC, importance DESC, m.id) AS rank FROM ({NEAR}) n JOIN memories m ON m.id = n.id WHERE tier < 3) WHERE rank <= 30)
 GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 10""")
def indexed_hybrid(t):
    """Fused search of which both lists come from indexes."""
    q = query_vector(t)
    near = retrieval.vector_search(vectors(t).near(q, 90, exact=True, only=F.expr(WARM)), q, 30, 0.10, AS_OF)
    hits = texts(t).search("attion thtion", None, only=F.col("tier") < 3).withColumn("rank_score", F.round("rank_score", 12))
    words = hits.orderBy(F.desc("rank_score"), F.desc("importance"), "id").limit(30)
    lists = [retrieval.with_rank(near, F.desc("relevance"), F.asc("id")), retrieval.with_rank(words, F.desc("rank_score"), F.desc("importance"), F.asc("id"))]
    return retrieval.fused(lists, 10).select("id", F.round("score", 6).alias("score"), "lists")


def fused_sql(only: str = "") -> str:
    """SQL of fused search's (id, total), ten rows, over memories where ``only`` holds."""
    held = lambda sql: sql.replace("FROM memories WHERE ", f"FROM memories WHERE {only} AND ") if only else sql
    return f"""(SELECT id, sum(1.0 / (60 + rank)) AS total FROM (SELECT id, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM ({held(NEAREST % (90, 30))})
 UNION ALL SELECT id, row_number() OVER (ORDER BY s DESC, importance DESC, id) AS rank FROM (SELECT w.* FROM ({held(WORDS)}) w JOIN memories m ON m.id = w.id WHERE m.tier < 3 ORDER BY s DESC, w.importance DESC, w.id LIMIT 30)) GROUP BY 1 ORDER BY total DESC, id LIMIT 10)"""


@query(f"""SELECT f.id, round(total, 6) AS score, source_machine AS language, tags[1] AS kind FROM {fused_sql("list_has_any(tags, ['en', 'fr'])")} f JOIN memories m ON m.id = f.id""")
def symbol_search(t):
    """Code symbols by both lists, of rows with one of the tags."""
    rows = t.memories.withColumn("symbol", F.struct(F.col("source_machine").alias("language"), F.col("tags")[0].alias("kind")))
    return retrieval.symbol_search(rows, query_vector(t), "attion ertion", ["en", "fr"], 10, 0.10, AS_OF).withColumn("score", F.round("score", 6))


@query(f"SELECT f.id, round(total, 6) AS score, CASE WHEN f.id % 3 <> 0 THEN left(content, 60) WHEN length(content) < 200 THEN content END AS answer FROM {fused_sql()} f JOIN memories m ON m.id = f.id")
def distilled_hits(t):
    """Fused search's hits, distilled by a rule that says nothing of every third."""
    judge = lambda rows: rows.withColumn("answer", F.when(F.col("id") % 3 != 0, F.left("content", F.lit(60))))
    return retrieval.distilled(t.memories, query_vector(t), "attion ertion", 10, 0.10, AS_OF, judge).withColumn("score", F.round("score", 6))
