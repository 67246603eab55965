"""Joins between memories, entities and their links; candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, cut_one_by_one
from .similarity_join import similar_pairs
from .stats import ago


def entity_memories_of(memories: DataFrame, links: DataFrame, entity: int) -> DataFrame:
    mine = links.where(F.col("entity_id") == entity)
    return mine.join(memories, mine["memory_id"] == memories["id"]).select("id", "created_at", mine["confidence"].alias("link_confidence"), "role")


def memory_entities_of(entities: DataFrame, links: DataFrame, memory: int) -> DataFrame:
    mine = links.where(F.col("memory_id") == memory)
    return mine.join(entities, mine["entity_id"] == entities["id"]).select("id", "name", "entity_type", "confidence", "role")


def connections_of(entities: DataFrame, relations: DataFrame, entity: int) -> DataFrame:
    """Valid edges of an entity, which way they go, and the other end's name."""
    mine = relations.where("valid").where((F.col("source_id") == entity) | (F.col("target_id") == entity)).withColumn("direction", F.when(F.col("source_id") == entity, "outgoing").otherwise("incoming"))
    other = mine.withColumn("other_id", F.when(F.col("source_id") == entity, F.col("target_id")).otherwise(F.col("source_id")))
    return other.join(entities.select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id", "left").select("id", "direction", "relationship_type", "other_id", "other_name", "confidence")


def contradiction_pairs(memories: DataFrame, least: float, most: float) -> DataFrame:
    """Pairs in a band of similarity, neither archived, that differ in machine or kind or are over a week apart."""
    m = memories.where("category <> '_archived'")
    pairs = similar_pairs(m.select("id", "embedding"), least, most)
    side = lambda p: m.select(F.col("id").alias(p), F.col("source_machine").alias(f"machine_{p}"), F.col("source_type").alias(f"type_{p}"), F.col("created_at").alias(f"at_{p}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = ~F.col("machine_a").eqNullSafe(F.col("machine_b")) | (F.col("type_a") != F.col("type_b")) | (F.col("at_a") < F.col("at_b") - F.expr("interval 7 days"))
    return both.where(differ).select("a", "b", "similarity")


def same_name_pairs(entities: DataFrame, block: int = 4096) -> DataFrame:
    """Pairs of one canonical name and different types, by summed mentions.

    A name's entities are dealt into blocks, and each pair of blocks is a key of the join, so that a crowded name is many
    tasks and no pair is formed twice. All pairs of a name are the result: it grows with the square of a name's entities."""
    e = entities.select("id", "canonical_name", "entity_type", "mention_count").where("canonical_name is not null and entity_type is not null")
    sizes = cut(e.groupBy("canonical_name").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"), "same-names")  # written, so that a crowded name can be split in the join
    placed = e.join(sizes, "canonical_name", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("g", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"i": F.least("g", "o"), "j": F.greatest("g", "o")})
    a, b = dealt.where("g = i").alias("a"), dealt.where("g = j").alias("b")
    same = (F.col("a.canonical_name") == F.col("b.canonical_name")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    # Blocks of one number are met from one side; those of others share no identifier. Each pair of entities is met once.
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.id") < F.col("b.id"))
    pairs = a.join(b, same & once & (F.col("a.entity_type") != F.col("b.entity_type")))
    return pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), F.col("a.canonical_name").alias("name"), (F.col("a.mention_count") + F.col("b.mention_count")).cast("long").alias("mentions"))


def best_same_name_pairs(entities: DataFrame, k: int, only: Column, first: int = 64) -> DataFrame:
    """The k pairs of ``same_name_pairs`` by falling mentions, then a and b, of those where ``only`` (of a and b) holds, without forming the others.

    The pairs of each name's ``first`` most mentioned entities tell how many mentions the k-th pair has at least. Then only
    entities are met that reach as many with their name's most mentioned one: exact, whatever ``first`` is."""
    e = entities.select("id", "canonical_name", "entity_type", "mention_count")
    best = lambda rows: same_name_pairs(rows).where(only).orderBy(F.desc("mentions"), "a", "b").limit(k)
    w = Window.partitionBy("canonical_name").orderBy(F.desc("mention_count"), "id")
    some = best(e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first).drop("rank")).agg(F.count("mentions").alias("n"), F.min("mentions").alias("least")).first()
    if some.n < k:
        return best(e)
    most = e.groupBy("canonical_name").agg(F.max("mention_count").alias("most"))
    reach = e.join(most, "canonical_name").where(F.col("mention_count") + F.col("most") >= some.least).drop("most")
    return best(reach)


def cooccurrences(links: DataFrame, least: int, sample: int = 3, block: int = 512, most: int = 1 << 26) -> DataFrame:
    """Entity pairs in at least ``least`` memories, with the first ``sample`` of these.

    A memory's entities are dealt into blocks, and each pair of blocks is a key of the join, so that a memory of very many
    entities is no single task. Only each task's first memories of a pair are carried: ``sample`` least values, merged.

    Pairs are formed and counted in slices by a hash of their lesser entity, of some ``most`` pairs (or as many as there are links), so that their shuffles do not
    all lie on disk at once: their number grows with the square of a memory's entities."""
    l = cut(links.select("memory_id", "entity_id").distinct(), "links")  # noqa: E741
    per = l.groupBy("memory_id").agg(F.count("*").alias("n"))
    n_pairs, n_links = per.agg(F.sum(F.expr("n * (n - 1) div 2")), F.sum("n")).first()
    n = max(1, -(-(n_pairs or 0) // max(most, n_links or 0)))
    sizes = cut(per.select("memory_id", F.ceil(F.col("n") / block).cast("int").alias("blocks")).where("blocks > 1"), "cooccurring")  # written, so that a crowded memory can be split in the join
    placed = l.join(sizes, "memory_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("g", F.pmod(F.xxhash64("entity_id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).select("memory_id", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "g", "entity_id")
    same = (F.col("a.memory_id") == F.col("b.memory_id")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    # Blocks of one number are met from one side, others from both, each pair of entities once.
    once = F.when(F.col("a.i") == F.col("a.j"), F.col("a.entity_id") < F.col("b.entity_id")).otherwise(F.col("a.entity_id") != F.col("b.entity_id"))

    def part(s: int) -> DataFrame:
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(n)) == s if n > 1 else F.lit(True)
        # Where blocks have one number the lesser entity is a's, so that others need not be met.
        a, b = dealt.where("g = i").where((F.col("i") != F.col("j")) | mine("entity_id")).alias("a"), dealt.where("g = j").alias("b")
        pairs = a.join(b, same).where(once).select(F.least("a.entity_id", "b.entity_id").alias("e1"), F.greatest("a.entity_id", "b.entity_id").alias("e2"), F.col("a.memory_id").alias("memory_id")).where(mine("e1"))
        counted = cut(pairs.groupBy("e1", "e2").agg(F.count("*").alias("shared")).where(F.col("shared") >= least), "cooccurring")
        first = pairs.join(counted.select("e1", "e2"), ["e1", "e2"], "left_semi")
        ranked_ = first.withColumn("rank", F.row_number().over(Window.partitionBy("e1", "e2").orderBy("memory_id"))).where(F.col("rank") <= sample)
        samples = ranked_.groupBy("e1", "e2").agg(F.array_sort(F.collect_list("memory_id")).alias("sample"))  # ``sample`` a pair
        return counted.join(samples, ["e1", "e2"])

    return part(0) if n == 1 else cut_one_by_one(part, n, "cooccurring")


def unlinked(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs without an edge either way: edges are turned to (less, greater) once, so one anti join does."""
    edges = relations.select(F.least("source_id", "target_id").alias("e1"), F.greatest("source_id", "target_id").alias("e2")).distinct()
    return pairs.join(edges, ["e1", "e2"], "left_anti")


def unprocessed(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Events of these kinds that no marker names."""
    marks = events.where("event_type = 'insight_processed'").select(F.col("source_event_id").alias("id")).where("id is not null").distinct()
    return events.where(F.col("event_type").isin(kinds)).join(marks, "id", "left_anti")


def synthesis_candidates(entities: DataFrame, links: DataFrame, memories: DataFrame, cooling: DataFrame, least: int) -> DataFrame:
    """Entities with at least ``least`` memories, newest first, that no recent marker names. Ranked before five are collected, so that no list is long."""
    joined = links.join(memories.select(F.col("id").alias("memory_id"), "created_at"), "memory_id")
    counts = joined.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = ranked(joined.withColumnRenamed("entity_id", "id"), "id", F.desc("created_at"), "memory_id").where("rank <= 5").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda s: s["memory_id"]).alias("ids"))
    return counts.join(cooling.select("id"), "id", "left_anti").join(first, "id").join(entities.select("id", "name"), "id").select("id", "name", "n", F.array_join("ids", ",").alias("newest"))


def underdescribed(entities: DataFrame, links: DataFrame) -> DataFrame:
    few = entities.where("(description is null or length(description) < 20) and mention_count >= 2")
    return few.join(links.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"), F.max("memory_id").alias("last_memory")), "id").select("id", "name", "n", "last_memory")


def cross_machine(entities: DataFrame, links: DataFrame, memories: DataFrame, least: int = 2, cooling: DataFrame | None = None) -> DataFrame:
    """Entities seen from several machines, but for those of ``cooling`` (id)."""
    links = links if cooling is None else links.join(cooling.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_anti")
    joined = links.join(memories.select(F.col("id").alias("memory_id"), "source_machine"), "memory_id")
    grouped = joined.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("source_machine").alias("machines"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source_machine")), ",").alias("names"))
    return grouped.where(F.col("machines") >= least).join(entities.select("id", "name"), "id")


def extraction_samples(entities: DataFrame, links: DataFrame, validated: DataFrame, as_of: str, days: int) -> DataFrame:
    """Links of new entities that are not validated yet."""
    new = entities.where(F.col("created_at") >= ago(as_of, days)).join(validated.select("id"), "id", "left_anti")
    return new.join(links, new["id"] == links["entity_id"]).select("id", "name", "memory_id", "confidence")


def research_candidates(entities: DataFrame, links: DataFrame, recent: DataFrame, types: list[str], least: int) -> DataFrame:
    wanted = entities.where(F.col("entity_type").isin(types) & (F.col("mention_count") >= least)).join(recent.select("id"), "id", "left_anti")
    counts = links.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("memory_id").alias("n_memories"))
    return wanted.join(counts, "id", "left").select("id", "name", "mention_count", F.coalesce("n_memories", F.lit(0)).alias("n_memories"))


def graph_nodes(entities: DataFrame, links: DataFrame, least: int) -> DataFrame:
    counts = links.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("links"))
    return entities.join(counts, "id").where(F.col("links") >= least).select("id", "name", "entity_type", "links")


def graph_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Valid edges with both ends among the nodes."""
    n = nodes.select("id")
    return relations.where("valid").join(n.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(n.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("id", "source_id", "target_id", "relationship_type", F.round("confidence", 2).alias("confidence"))


def chunk_neighbours(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """Around each hit, the chunks of the same document at most ``window`` places away: an equi-join on exploded places."""
    wanted = hits.select(F.col("id").alias("hit_id"), "document_id", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    near = wanted.join(chunks.select("document_id", "chunk_index", "id"), ["document_id", "chunk_index"])
    return near.groupBy("hit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda s: s["id"]), ",").alias("around"))


def prunable(entities: DataFrame, links: DataFrame, most_links: int = 1, as_of: str | None = None, hours: int = 0) -> DataFrame:
    """Entities with few links; with ``as_of``, of those made more than ``hours`` before."""
    if as_of is not None:
        entities = entities.where(F.col("created_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))
    counts = links.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("links"))
    return entities.join(counts, "id", "left").where(F.coalesce("links", F.lit(0)) <= most_links).select("id", "canonical_name", F.coalesce("links", F.lit(0)).alias("links"))


def dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with a missing end."""
    e = entities.select(F.col("id").alias("e"))
    return relations.join(e, F.col("source_id") == F.col("e"), "left_anti").unionByName(relations.join(e, F.col("target_id") == F.col("e"), "left_anti")).distinct()


def recent_feedback(outcomes: DataFrame, memories: DataFrame, as_of: str, days: int, k: int) -> DataFrame:
    recent = outcomes.where(F.col("created_at") >= ago(as_of, days)).orderBy(F.desc("created_at"), "memory_id", "was_useful").limit(k)
    return recent.join(memories.select(F.col("id").alias("memory_id"), "category"), "memory_id", "left").select("memory_id", "was_useful", "category", F.unix_micros("created_at").alias("at_us"))


def ranked(df: DataFrame, by: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
