"""The queries of this subpackage: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest_neighbours
from .bpe import encoding_digest
from .common import read_table
from .impact import top_products
from .jpeg import media_digest
from .lexical import lexical_search
from .near import near_duplicates
from .packing import pack
from .periodic import run_digest
from .quality import quality
from .secrets import secret_digest
from .sstable import token_tables
from .suffix import removal_digest
from .toxicity import toxicity


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers keep a file; the same on every machine that has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(read_table(spark, sf_dir, "documents"))


def op3_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(read_table(spark, sf_dir, "documents"), with_text=True)


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), n=4)


def op7_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_heap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_impact_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read_table(spark, sf_dir, "embeddings"))


def op13_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sstable": op1_sstable,
    "op2_progressive_jpeg": op2_progressive_jpeg,
    "op3_bwt_merge": op3_bwt_merge,
    "op4_kmeans_tree": op4_kmeans_tree,
    "op5_toxicity": op5_toxicity,
    "op6_setsketch": op6_setsketch,
    "op7_residual_packing": op7_residual_packing,
    "op8_trie_bpe": op8_trie_bpe,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_heap_merge": op11_heap_merge,
    "op12_impact_order": op12_impact_order,
    "op13_automaton_runs": op13_automaton_runs,
}

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE_SQL: dict[str, str] = {
    "op11_heap_merge": f"""
WITH cut AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_number() OVER () AS d, doc_id, terms, len(terms) AS n FROM cut WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term),
item AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total WHERE term IN (SELECT term FROM item) GROUP BY term),
scored AS (SELECT item_id, docs.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM item JOIN w USING (term) JOIN tf USING (term) JOIN docs USING (d), total GROUP BY item_id, d, docs.doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op12_impact_order": """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS units FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.units AS DOUBLE[]), CAST(c.units AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
