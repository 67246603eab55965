"""Write paths: chunked stores, re-embedding, queues, handoffs, contexts, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import chunked, embedding_input
from ..plans.providers import Embed, embedded


def document_store(documents: DataFrame, most: int = 8000, chunk: int = 6000, overlap: int = 500) -> DataFrame:
    """Short documents as one memory; longer ones as chunks with their place and a numbered summary."""
    short = documents.where(F.length("content") <= most).select(F.col("id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), F.lit(1).cast("long").alias("chunk_total"), F.lit(0).cast("long").alias("chunk_offset"), "content", "title")
    long_ = documents.where(F.length("content") > most)
    parts = chunked(long_, chunk, overlap, keep=("title",)).select(F.col("id").alias("document_id"), "chunk_index", "chunk_total", "chunk_offset", F.col("chunk").alias("content"), "title")
    numbered = F.when(F.col("chunk_total") > 1, F.left(F.format_string("%s [%d/%d]", F.coalesce("title", F.lit("")), F.col("chunk_index") + 1, F.col("chunk_total")), F.lit(200))).otherwise(F.col("title"))
    return short.unionByName(parts).withColumn("summary", numbered)


def rechunked(memories: DataFrame, most: int = 8000) -> DataFrame:
    """Oversized memories without a chunk place, as chunks that name their origin."""
    big = memories.where((F.length("content") > most) & F.col("chunk_index").isNull())
    return chunked(big).withColumnRenamed("id", "rechunked_from")


def reembedded(memories: DataFrame, embed: Embed, most: int = 2000) -> DataFrame:
    """id, embedding of every row from category, tags and content."""
    text = F.left(embedding_input(F.lit(None).cast("string"), F.col("category"), F.col("tags"), F.col("content")), F.lit(most))
    return embedded(memories.select("id", text.alias("text")), "text", embed).select("id", "embedding")


def queued(queue: DataFrame, links: DataFrame, per_page: int = 5, least: float = 0.4) -> DataFrame:
    """New queue rows: of each page the best links that score enough and are not queued yet."""
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "url")
    best = links.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_page)
    return best.groupBy("url").agg(F.min("page_id").alias("page_id"), F.max("score").alias("score")).join(queue.select("url").distinct(), "url", "left_anti")


def marked_crawled(queue: DataFrame, done: DataFrame, at: str, key: Sequence[str] = ("url",)) -> DataFrame:
    """Queue rows with the time and error of those done, told by ``key``: a queue that holds a url in several rows needs more than the url. Done rows may repeat a key."""
    d = done.groupBy(*key).agg(F.min("error").alias("__error"), F.lit(True).alias("__done"))
    return queue.drop("crawled_at", "error").join(d, list(key), "left").withColumn("crawled_at", F.when(F.col("__done"), F.lit(at).cast("timestamp"))).withColumnRenamed("__error", "error").drop("__done")


def open_handoffs(memories: DataFrame, k: int, resolved: Sequence[str] = ("completed", "superseded", "abandoned")) -> DataFrame:
    """Handoffs in no resolved state, newest first."""
    tags = F.array(*[F.lit(f"handoff:{r}") for r in resolved])
    return memories.where(F.array_contains("tags", "handoff") & ~F.arrays_overlap("tags", tags)).orderBy(F.desc("created_at"), "id").limit(k)


def handoff_document(title: Column, done: Column, todo: Column, notes: Column) -> Column:
    numbered = lambda items: F.array_join(F.transform(items, lambda x, i: F.format_string("%d. %s", i + 1, x)), "\n")
    part = lambda head, body: F.when(F.coalesce(F.length(body), F.lit(0)) > 0, F.concat(F.lit(f"## {head}\n"), body))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), part("Done", numbered(done)), part("To do", numbered(todo)), part("Notes", notes))


def context_of(ranked: DataFrame) -> DataFrame:
    """One text of numbered memories, by query: summary, or the first 300 characters."""
    line = F.format_string("[%d] %s", F.col("rank"), F.coalesce("summary", F.left("content", F.lit(300))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("context"))


def distilled_sizes(pairs: DataFrame) -> DataFrame:
    """Compression of (source, distilled): ratio and tokens saved; short sources pass through."""
    out = F.when(F.length("source") < 200, F.col("source")).otherwise(F.col("distilled"))
    return pairs.select("id", F.round(F.length(out) / F.greatest(F.length("source"), F.lit(1)), 4).alias("ratio"), F.expr(f"(length(source) - length(case when length(source) < 200 then source else distilled end)) div 4").alias("tokens_saved"))


def compressed_messages(messages: DataFrame, first: int = 2, last: int = 4, most: int = 500) -> DataFrame:
    """By conversation: the first and last messages, cut."""
    w = Window.partitionBy("conv_id")
    n = messages.withColumn("p", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w)).where((F.col("p") <= first) | (F.col("p") > F.col("n") - last))
    return n.select("conv_id", "turn", "role", F.left("text", F.lit(most)).alias("text"))


def container_name(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"Container '([^']*)'", 1), F.lit(""))


def community_list(members: DataFrame, entities: DataFrame, k: int, names: int = 10) -> DataFrame:
    """(community, size, names) of the largest communities, with the most mentioned names."""
    joined = members.join(entities.select(F.col("id").alias("node"), "name", "mention_count"), "node", "left")
    sizes = joined.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(k)
    w = Window.partitionBy("community").orderBy(F.desc(F.coalesce("mention_count", F.lit(0))), "name", "node")
    first = joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= names)
    listed = first.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias("names"))
    return sizes.join(listed, "community", "left").orderBy(F.desc("size"), "community")


def merged_communities(members: DataFrame, links: DataFrame, least: int = 15) -> DataFrame:
    """(node, community): small communities join a large one one after the other, the larger first (ties: the lesser name), then what is left is bundled.

    A small community joins the large one that its nodes have most links with (ties: the lesser), where a large one counts with all that have joined it
    before. So it waits only for those that it is linked to and that come before it: each round decides all that wait for none, whatever their
    number. Those without a link to any large one are bundled in the same order, a bundle ending when it has ``least`` nodes. Without large communities all stay.
    Communities are named by the large one, bundles by their least name."""
    size = cut(members.groupBy("community").agg(F.count("*").alias("size")), "sizes")
    if not size.where(F.col("size") >= least).take(1):
        return members.select("node", "community")
    ends = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    inside = lambda node, name: members.select(F.col("node").alias(node), F.col("community").alias(name))
    small = size.where(F.col("size") < least).select("community", (-F.col("size")).alias("o"))
    counted = ends.join(inside("u", "minor"), "u").join(inside("v", "other"), "v").where("minor <> other").groupBy("minor", "other").agg(F.count("*").alias("n"))
    order = lambda name: small.select(F.col("community").alias(name), F.struct("o", "community").alias(f"{name}_at"))
    # Of each small community: its links to large ones, and to small ones that come before it.
    pairs = counted.join(order("minor"), "minor").join(order("other"), "other", "left").where("other_at is null or other_at < minor_at")
    pairs = cut(pairs.select("minor", "other", "n"), "community-links")
    placed = cut(size.where(F.col("size") >= least).select("community", F.col("community").alias("root")), "placed")
    left = cut(small.select("community"), "left")
    while left.take(1):
        here = pairs.join(left.select(F.col("community").alias("minor")), "minor", "left_semi")
        waits = here.join(left.select(F.col("community").alias("other")), "other", "left_semi").select(F.col("minor").alias("community")).distinct()
        ready = left.join(waits, "community", "left_anti")
        votes = here.join(placed.where("root is not null").select(F.col("community").alias("other"), "root"), "other").groupBy("minor", "root").agg(F.sum("n").alias("n"))
        best = votes.groupBy(F.col("minor").alias("community")).agg(F.max_by("root", F.struct("n", (-F.col("root")).alias("r"))).alias("root"))
        now = cut(ready.join(best, "community", "left"), "placed")
        left = cut(left.join(now.select("community"), "community", "left_anti"), "left")
        placed = placed.unionByName(now)
    placed = cut(placed, "placed")
    bundles = bundled(size.join(placed.where("root is null").select("community"), "community", "left_semi"), least)
    named = placed.join(bundles, "community", "left").select("community", F.coalesce("root", "bundle").alias("name"))
    return members.join(named, "community").select("node", F.col("name").alias("community"))


def bundled(orphans: DataFrame, least: int) -> DataFrame:
    """(community, bundle) of small communities (community, size), taken by falling size, then name, a bundle ending when it has ``least`` nodes or more.

    Sizes are under ``least``, so that where each size's bundles begin follows from how many communities have each size; a community's bundle then follows from its place."""
    counts = sorted(((r.size_, r.n) for r in orphans.groupBy(F.col("size").alias("size_")).agg(F.count("*").alias("n")).collect()), reverse=True)  # under ``least`` rows
    rules, filled, bundle, first = [], 0, 0, 0
    for size, n in counts:
        rest, whole = -(-(least - filled) // size), -(-least // size)  # how many end the open bundle, and how many make one
        rules.append((size, first, rest, whole, bundle))
        if n < rest:
            filled += n * size
        else:
            more, over = divmod(n - rest, whole)
            bundle, filled = bundle + 1 + more, over * size
        first += n
    # Places: a sort by ranges, and each part's first place.
    ordered = cut(orphans.orderBy(F.desc("size"), "community").withColumn("at", F.monotonically_increasing_id()), "orphans")
    parts, before = [], 0
    for r in ordered.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect():  # partitions
        parts.append((r.part, before))
        before += r["count"]
    spark = orphans.sparkSession
    starts = F.broadcast(spark.createDataFrame(parts, "part long, before long"))
    table = F.broadcast(spark.createDataFrame(rules, "size long, first long, rest long, whole long, base long"))
    placed = ordered.withColumn("part", F.shiftright("at", 33)).join(starts, "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).join(table, "size")
    j = F.col("place") - F.col("first")
    numbered = placed.select("community", F.when(j < F.col("rest"), F.col("base")).otherwise(F.col("base") + 1 + F.floor((j - F.col("rest")) / F.col("whole"))).alias("number"))
    named = cut(numbered.groupBy("number").agg(F.min("community").alias("bundle")), "bundles")
    return numbered.join(named, "number").select("community", "bundle")


def ring_layout(nodes: DataFrame, radius: float = 100.0) -> DataFrame:
    """Places of the nodes of each community on a ring."""
    w = Window.partitionBy("community")
    turn = 2 * 3.141592653589793 * (F.row_number().over(w.orderBy("node")) - 1) / F.count("*").over(w)
    return nodes.withColumn("turn", turn).select("node", "community", F.round(radius * F.cos("turn"), 4).alias("x"), F.round(radius * F.sin("turn"), 4).alias("y"))


def error_patterns(errors: DataFrame) -> DataFrame:
    """Known errors (id, error, context, solution, tags) as memories: structured text, tagged for error search."""
    part = lambda head, body: F.when(F.length(F.trim(body)) > 0, F.concat(F.lit(f"**{head}:** "), body))
    text = F.concat_ws("\n\n", F.concat(F.lit("## Error: "), "error"), part("Context", F.col("context")), part("Solution", F.col("solution")))
    return errors.select("id", text.alias("content"), F.concat(F.array(F.lit("error-pattern")), F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), F.lit("debugging").alias("category"))


def community_summaries(members: DataFrame, entities: DataFrame, judge, k: int = 50, most: int = 30) -> DataFrame:
    """(community, size, summary) of the k largest communities. The judge sees ``members``, at most ``most`` of "name: description", and adds summary."""
    joined = members.join(entities.select(F.col("id").alias("node"), "name", "description", "mention_count"), "node")
    sizes = joined.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(k)
    w = Window.partitionBy("community").orderBy(F.desc("mention_count"), "name", "node")
    line = F.concat_ws(": ", "name", F.left("description", F.lit(100)))
    first = joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    listed = first.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]).alias("members"))
    return judge(sizes.join(listed, "community")).where("length(summary) > 0").select("community", "size", "summary")
