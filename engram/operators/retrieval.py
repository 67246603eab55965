"""Vector, lexical and fused retrieval."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stems import STOP_WORDS, stem, terms
from ..functions.vectors import as_vector, cosine, relevance
from .filters import matching

MODEL = "current"
WORD = re.compile("[a-z0-9]+")


def scored(memories: DataFrame, vector: Sequence[float], include_cold: bool = False, model: str | None = MODEL) -> DataFrame:
    """Rows with a similarity to the query: embedded, of the current model or an unnamed one, and not cold."""
    df = memories.where("embedding is not null")
    if model is not None:
        df = df.where(F.col("embedding_model").isNull() | (F.col("embedding_model") == model))
    if not include_cold:
        df = df.where("tier < 3")
    return df.withColumn("similarity", cosine(F.col("embedding"), as_vector(vector)))


def vector_search(memories: DataFrame, vector: Sequence[float], k: int, threshold: float, as_of: str, include_cold: bool = False, model: str | None = MODEL, **filters) -> DataFrame:
    """Nearest max(3k, 20) by distance, ordered anew by relevance, cut to k. Two top-k stages, no full sort."""
    df = scored(matching(memories, **filters), vector, include_cold, model).where(F.col("similarity") >= threshold)
    near = df.orderBy(F.desc("similarity"), "id").limit(max(3 * k, 20))
    return near.withColumn("relevance", relevance(F.col("similarity"), F.col("quality_score"), F.col("importance"), F.col("created_at"), as_of)).orderBy(F.desc("relevance"), "id").limit(k)


def duplicate_candidates(memories: DataFrame, vector: Sequence[float], k: int, threshold: float, exclude: int | None = None) -> DataFrame:
    """The k nearest of all rows; the threshold comes after the limit."""
    df = memories.where("embedding is not null").withColumn("similarity", cosine(F.col("embedding"), as_vector(vector)))
    if exclude is not None:
        df = df.where(F.col("id") != exclude)
    return df.orderBy(F.desc("similarity"), "id").limit(k).where(F.col("similarity") >= threshold)


def tokens(column: str) -> Column:
    return F.filter(F.split(F.lower(F.col(column)), "[^a-z0-9]+"), lambda t: t != "")


def text_search(memories: DataFrame, query: str, k: int | None) -> DataFrame:
    """Rows that hold all words, by summed term frequency over log length; all of them, in no order, where k is None.

    Extra syntax: "quoted phrases", or between alternatives, -word for words that must not occur."""
    t = tokens("content")
    good, groups, banned = F.lit(True), [], []
    parts = _parsed(query)
    for negative, words in parts:
        (banned if negative else groups).append(words)
    if not groups:
        return memories.limit(0).withColumn("rank_score", F.lit(0.0))
    hit = lambda phrase: F.array_contains(t, phrase[0]) if len(phrase) == 1 else F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")).contains(" " + " ".join(phrase) + " ")
    for alternatives in groups:
        any_ = F.lit(False)
        for phrase in alternatives:
            any_ = any_ | hit(phrase)
        good = good & any_
    for alternatives in banned:
        good = good & ~hit(alternatives[0])
    words = sorted({w for g in groups for p in g for w in p})
    found = F.size(F.filter(t, lambda x: x.isin(words)))
    hits = memories.where(good).withColumn("rank_score", found / F.log(F.size(t) + F.lit(math.e)))
    return hits if k is None else hits.orderBy(F.desc("rank_score"), F.desc("importance"), "id").limit(k)


def stemmed_counts(memories: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(id, hits array<int>, words): how often each wanted stem stands in the content, and how many words it has. Whole texts, in Arrow batches."""
    places = {t: i for i, t in enumerate(wanted)}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            hits, sizes = [], []
            for text in p["content"]:
                found = [0] * len(places)
                words = WORD.findall((text or "").lower())
                for w in words:
                    if (i := places.get(stem(w))) is not None and w not in STOP_WORDS:
                        found[i] += 1
                hits.append(found)
                sizes.append(len(words))
            yield pd.DataFrame({"id": p["id"], "hits": hits, "words": sizes})

    return memories.select("id", "content").mapInPandas(run, "id long, hits array<int>, words long")


def stemmed_search(memories: DataFrame, query: str, k: int | None) -> DataFrame:
    """(id, rank_score, importance): rows that hold the stems of all words but stop words, by summed frequency over log length, then importance.

    A query of stop words alone finds nothing."""
    wanted = terms(query)
    if not wanted:
        return memories.limit(0).select("id", F.lit(0.0).alias("rank_score"), "importance")
    found = stemmed_counts(memories, wanted).where(F.forall("hits", lambda n: n > 0))
    score = F.aggregate("hits", F.lit(0), lambda a, n: a + n) / F.log(F.col("words") + F.lit(math.e))
    hits = found.select("id", score.alias("rank_score")).join(memories.select("id", "importance"), "id")
    return hits if k is None else hits.orderBy(F.desc("rank_score"), F.desc("importance"), "id").limit(k)


def smart_recall(memories: DataFrame, vector: Sequence[float] | None, text: str, k: int, as_of: str, threshold: float = 0.25) -> DataFrame:
    """(id, score): fused search, k of 20 at most; where the question could not be embedded (no vector), by words alone."""
    k = max(1, min(k, 20))
    if vector is None:
        return text_search(memories, text, k).select("id", F.col("rank_score").alias("score"))
    return hybrid_search(memories, vector, text, k, threshold, as_of).select("id", "score")


def code_search(memories: DataFrame, query: str, tags: Sequence[str], k: int) -> DataFrame:
    """Symbols (id, language, kind) whose text holds the words, of rows with one of the tags."""
    return text_search(matching(memories, tags=tags), query, k).select("id", "symbol.*")


def symbol_search(memories: DataFrame, vector: Sequence[float], text: str, tags: Sequence[str], k: int, threshold: float, as_of: str, **options) -> DataFrame:
    """Symbols (id, score, language, kind) by fused search over rows with one of the tags."""
    hits = hybrid_search(memories, vector, text, k, threshold, as_of, tags=tags, **options)
    return hits.join(memories.select("id", "symbol"), "id").select("id", "score", "symbol.*")


def distilled(memories: DataFrame, vector: Sequence[float], text: str, k: int, threshold: float, as_of: str, judge, **options) -> DataFrame:
    """(id, score, answer): what a judge distils of each text that fused search finds, as ``jobs.compressed`` has it."""
    from .jobs import compressed

    hits = hybrid_search(memories, vector, text, k, threshold, as_of, **options)
    return compressed(hits.select("id", "score").join(memories.select("id", "content"), "id"), judge).select("id", "score", "answer")


def _parsed(query: str) -> list[tuple[bool, list[list[str]]]]:
    """(negative, alternatives), each alternative a phrase of words."""
    out: list[tuple[bool, list[list[str]]]] = []
    joined = False
    for quoted, plain in re.findall(r'(-?"[^"]*")|(\S+)', query.lower()):
        word = quoted or plain
        if word == "or":
            joined = bool(out)
            continue
        negative = word.startswith("-")
        phrase = re.findall(r"[a-z0-9]+", word)
        if not phrase:
            continue
        if joined and not negative and not out[-1][0]:
            out[-1][1].append(phrase)
        else:
            out.append((negative, [phrase]))
        joined = False
    return out


def fused(lists: Sequence[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists: the sum of 1 / (constant + rank)."""
    all_ = lists[0].select("id", "rank")
    for x in lists[1:]:
        all_ = all_.unionByName(x.select("id", "rank"))
    return all_.groupBy("id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.count("*").alias("lists")).orderBy(F.desc("score"), "id").limit(k)


def with_rank(df: DataFrame, *order: Column) -> DataFrame:
    """Ranks of a list that a limit has already bounded, so that one task may hold it."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid_search(memories: DataFrame, vector: Sequence[float], text: str, k: int, threshold: float, as_of: str, include_cold: bool = False, model: str | None = MODEL, **filters) -> DataFrame:
    """Vector and text lists of max(3k, 20), fused."""
    n = max(3 * k, 20)
    near = vector_search(memories, vector, n, threshold, as_of, include_cold, model, **filters)
    kept = matching(memories, **filters)
    words = text_search(kept if include_cold else kept.where("tier < 3"), text, n)
    return fused([with_rank(near, F.desc("relevance"), F.asc("id")), with_rank(words, F.desc("rank_score"), F.desc("importance"), F.asc("id"))], k)


def multi_query(memories: DataFrame, queries: Sequence[tuple[Sequence[float], str]], k: int, threshold: float, as_of: str, **options) -> DataFrame:
    """Several variants of a question, each searched with 5k rows and fused."""
    lists = [hybrid_search(memories, v, t, 5 * k, threshold, as_of, **options) for v, t in queries]
    return lists[0].limit(k) if len(lists) == 1 else fused([with_rank(x, F.desc("score"), F.asc("id")) for x in lists], k)


def graph_search(memories: DataFrame, entity_vectors: DataFrame, links: DataFrame, relations: DataFrame, vector: Sequence[float], k: int, depth: int, least: float = 0.3, seeds: int = 5, entities: int = 20) -> DataFrame:
    """Memories of the entities around those nearest to the query, warm ones only."""
    from .graph import neighbourhood

    start = entity_vectors.withColumn("similarity", cosine(F.col("embedding"), as_vector(vector))).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(seeds)
    around = neighbourhood(relations, start.select("id"), depth).groupBy("id").agg(F.min("depth").alias("depth")).unionByName(start.select("id", F.lit(0).alias("depth")))
    few = around.groupBy("id").agg(F.min("depth").alias("depth")).orderBy("depth", "id").limit(entities)
    hits = links.join(few.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(F.col("memory_id").alias("id")).distinct()
    return memories.where("tier < 3").join(hits, "id", "left_semi").orderBy(F.desc("importance"), "id").limit(k)


def relevant_communities(communities: DataFrame, judge, least: float = 0.3, k: int = 10) -> DataFrame:
    """The ``k`` communities that a judge finds most relevant, of those with a summary. The judge adds answer (relevant, score, key_points), null where it failed."""
    said = judge(communities.where("summary is not null and summary <> ''")).where(F.col("answer.relevant") & (F.col("answer.score") >= least))
    return said.select("community", "title", "summary", "topics", "names", "size", F.col("answer.score").alias("score"), F.col("answer.key_points").alias("key_points")).orderBy(F.desc("score"), "community").limit(k)


def global_answer(question: str, relevant: DataFrame, synthesise) -> DataFrame:
    """(answer, context) over the relevant communities, best first: each with its score, size, summary, topics, five names and key points. ``synthesise`` adds answer to (prompt, context)."""
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    part = F.concat(
        F.format_string("**%s** (relevance: %.1f, %d entities)\n", F.coalesce("title", F.lit("")), F.col("score").cast("double"), F.col("size").cast("long")), F.format_string("  Summary: %s\n", "summary"), F.format_string("  Topics: %s\n", listed(F.col("topics"))),
        F.format_string("  Key entities: %s\n", listed(F.slice("names", 1, 5))), F.array_join(F.transform(F.coalesce("key_points", F.array().cast("array<string>")), lambda p: F.concat(F.lit("  - "), p)), "\n"),
    )
    rows = relevant.select(F.col("score"), F.col("community"), part.alias("part"))  # ten at most
    context = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "community", "part"))), lambda x: x["part"]), "\n\n").alias("context"), F.count("*").alias("n")).where("n > 0")
    prompt = F.concat(F.lit(f"Question: {question}\n\nRelevant knowledge graph communities:\n\n"), "context", F.lit("\n\nSynthesize a comprehensive answer based on the communities above."))
    return synthesise(context.select(prompt.alias("prompt"), "context"))


def link_score(url: Column, trusted: Sequence[str], seeds: Sequence[str]) -> Column:
    """.4 for a trusted domain (else nothing at all), .3 for a documentation path, .2 or .1 for depth, .1 for a seed domain."""
    host, path = F.coalesce(F.lower(F.parse_url(url, F.lit("HOST"))), F.lit("")), F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    domain = F.regexp_replace(host, r"^www\.", "")
    known = lambda names: domain.isin(list(names)) if names else F.lit(False)
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    doc = path.rlike(r"(?i)/(docs?|guides?|tutorials?|reference|api|manual|learn)(/|$)")
    skip = path.rlike(r"(?i)/(blog|news|login|signup|pricing|careers|tag|category)(/|$)|\.(zip|tar|gz|pdf|exe|dmg|png|jpe?g|gif|svg|mp4)$")
    score = 0.4 + F.when(doc, 0.3).otherwise(0.0) + F.when(depth <= 3, 0.2).when(depth <= 5, 0.1).otherwise(0.0) + F.when(known(seeds), 0.1).otherwise(0.0)
    return F.when(~known(trusted) | skip, 0.0).otherwise(F.round(score, 2))
