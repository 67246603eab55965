"""Appends with identifiers and stamps, shallow merges, upserts and merges of whole rows.

Tables are snapshots: each function returns the rows to append, or the new snapshot. Identifiers are digests of
what names a row, so that a task that runs again makes the same ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOPIC_CHARS = 200
STRENGTHS = {"search": 1.0, "crawl": 2.0}


def ident(*parts: Column | str) -> Column:
    """32 hexadecimal digits that depend on the parts alone."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32))


def clamped(value: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), value))


def memories_stored(new: DataFrame, as_of: str) -> DataFrame:
    """Rows to append: identifier, stamps and the counters' first values. Confidence is held within 0 and 1, 1 if null.

    ``new`` has content, summary, source_type, source_machine, category, tags, confidence, metadata (a map) or some
    of them; rows without content are none. Two rows of one content, type and summary are one."""
    kinds = {"content": "string", "summary": "string", "source_type": "string", "source_machine": "string", "category": "string", "tags": "array<string>", "confidence": "double", "metadata": "map<string,string>"}
    rows = new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]).where("length(trim(content)) > 0")
    named = rows.withColumn("id", ident(F.coalesce("source_type", F.lit("")), F.coalesce("summary", F.lit("")), "content"))
    return named.dropDuplicates(["id"]).withColumns({"confidence": clamped(F.coalesce("confidence", F.lit(1.0)), 0.0, 1.0), "created_at": F.lit(as_of).cast("timestamp"), "updated_at": F.lit(as_of).cast("timestamp"), "access_count": F.lit(0).cast("long"), "importance": F.lit(0.0), "stability": F.lit(1.0), "extraction_status": F.lit(None).cast("string")})


def outcomes_stored(new: DataFrame, as_of: str) -> DataFrame:
    """Feedback to append: of each memory and context the last word counts once for a moment."""
    return new.select(ident(F.col("memory_id").cast("string"), F.coalesce("context", F.lit("")), F.lit(as_of)).alias("id"), "memory_id", "was_useful", "context", F.lit(as_of).cast("timestamp").alias("created_at"))


def events_logged(new: DataFrame, as_of: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """Events to append (event_type, description, agent_id, category, metadata); of the named kinds, if any are named."""
    rows = new if kinds is None else new.where(F.col("event_type").isin(list(kinds)))
    return rows.select(ident("event_type", F.coalesce("description", F.lit("")), F.lit(as_of)).alias("id"), "event_type", "description", F.coalesce("agent_id", F.lit("unknown")).alias("agent_id"), "category", "metadata", F.lit(as_of).cast("timestamp").alias("created_at"))


def signals_recorded(new: DataFrame, as_of: str) -> DataFrame:
    """Interest to append: topics of at most 200 characters, by how the interest showed; blank topics are none."""
    strength = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTHS.items() for x in kv]), F.col("kind")), F.lit(1.0))
    return new.where("length(trim(topic)) > 0").select(F.left(F.trim("topic"), F.lit(TOPIC_CHARS)).alias("topic"), strength.alias("strength"), F.lit(as_of).cast("timestamp").alias("created_at"))


def touched(before: DataFrame, after: DataFrame, columns: Sequence[str], as_of: str) -> DataFrame:
    """The new snapshot with updated_at: the moment for rows that differ or are new, else the old stamp."""
    old = before.select("id", F.struct(*columns).alias("__old"), F.col("updated_at").alias("__at"))
    both = after.drop("updated_at").join(old, "id", "left")
    same = F.col("__old").isNotNull() & F.struct(*columns).eqNullSafe(F.col("__old"))
    return both.withColumn("updated_at", F.when(same, F.col("__at")).otherwise(F.lit(as_of).cast("timestamp"))).drop("__old", "__at")


def metadata_merged(memories: DataFrame, patch: DataFrame) -> DataFrame:
    """Shallow merge of ``metadata`` (a map): the patch's keys replace, others stay; no patch, no change."""
    joined = memories.join(patch.select("id", F.col("metadata").alias("__new")), "id", "left")
    old, new = F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.col("__new")
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return joined.withColumn("metadata", F.when(new.isNull(), F.col("metadata")).otherwise(F.map_concat(kept, new))).drop("__new")


def entities_upserted(existing: DataFrame, mentions: DataFrame, as_of: str) -> DataFrame:
    """The new entity table. Of one canonical name and type the old identifier, name and description stay; each mention counts.

    mentions: name, entity_type, description, ord; a new entity takes its first mention's name and description."""
    canonical = F.lower(F.trim("name"))
    new = mentions.where("length(trim(name)) > 0").groupBy(canonical.alias("canonical_name"), "entity_type").agg(F.count("*").alias("__n"), F.min_by(F.struct("name", "description"), F.struct("ord", "name")).alias("__first"))
    columns = ["id", "name", "description", "mention_count", "created_at"]
    both = existing.select("canonical_name", "entity_type", *columns).join(new, ["canonical_name", "entity_type"], "full_outer")
    return both.select(
        F.coalesce(F.col("id").cast("string"), ident("canonical_name", "entity_type")).alias("id"), F.coalesce("name", "__first.name").alias("name"), "canonical_name", "entity_type",
        F.when(F.col("id").isNull(), F.col("__first.description")).otherwise(F.col("description")).alias("description"),
        (F.coalesce("mention_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("long").alias("mention_count"), F.coalesce("created_at", F.lit(as_of).cast("timestamp")).alias("created_at"),
    )


def relations_upserted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The new relation table. Of one edge: the greatest confidence, the last source memory named, the first properties.

    Both have source_id, target_id, relationship_type, confidence, source_memory, properties; new rows have ord."""
    keys = ["source_id", "target_id", "relationship_type"]
    columns = [*keys, "confidence", "source_memory", "properties"]
    both = existing.select(*columns, F.lit(0).alias("g"), F.lit(0).cast("long").alias("ord")).unionByName(new.select(*columns, F.lit(1).alias("g"), F.col("ord").cast("long").alias("ord")))
    # An old row's properties stay even where they are null, hence the struct around them.
    return both.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max_by("source_memory", F.when(F.col("source_memory").isNotNull(), F.struct("g", "ord", "source_memory"))).alias("source_memory"), F.min_by(F.struct("properties"), F.struct("g", "ord", F.col("properties").cast("string"))).alias("p")).select(*keys, "confidence", "source_memory", "p.properties")


def entities_merged(entities: DataFrame, links: DataFrame, relations: DataFrame, mapping: DataFrame) -> dict[str, DataFrame]:
    """Losers into winners (loser, winner; no winner loses): links and edges move unless the winner has the same, mentions add up, losers go."""
    into = mapping.select(F.col("loser").alias("__loser"), F.col("winner").alias("__winner"))

    def moved(df: DataFrame, column: str) -> DataFrame:
        j = df.join(into, F.col(column) == F.col("__loser"), "left")
        return j.withColumns({column: F.coalesce("__winner", column), f"__{column}": F.col("__winner").isNotNull()}).drop("__loser", "__winner")

    w = Window.partitionBy("entity_id", "memory_id", "role").orderBy("__entity_id", F.desc("confidence"))
    new_links = moved(links, "entity_id").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__entity_id")
    both = moved(moved(relations, "source_id"), "target_id").withColumn("__moved", F.col("__source_id") | F.col("__target_id"))
    w = Window.partitionBy("source_id", "target_id", "relationship_type").orderBy("__moved", "id")
    new_relations = both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__moved", "__source_id", "__target_id")
    added = entities.join(mapping, F.col("id") == F.col("loser")).groupBy(F.col("winner").alias("id")).agg(F.sum("mention_count").alias("__more"))
    left = entities.join(mapping.select(F.col("loser").alias("id")), "id", "left_anti").join(added, "id", "left")
    new_entities = left.withColumn("mention_count", F.col("mention_count") + F.coalesce("__more", F.lit(0))).drop("__more")
    return {"entities": new_entities, "links": new_links, "relations": new_relations}
