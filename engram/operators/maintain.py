"""Whole-table maintenance, upserts, versions. Each function returns the new snapshot or the changed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import ago

PROTECTED = ("manual", "synthesis", "claude")


def importance(memories: DataFrame, links: DataFrame) -> DataFrame:
    """.4 by links up to ten, .3 quality, .3 confidence, of embedded rows."""
    counts = links.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("links"))
    n = F.coalesce("links", F.lit(0))
    value = F.least(F.lit(1.0), 0.4 * F.least(F.lit(1.0), n / 10.0) + 0.3 * F.coalesce("quality_score", F.lit(0.5)) + 0.3 * F.coalesce("confidence", F.lit(0.7)))
    return memories.where("embedding is not null").join(counts, "id", "left").select("id", F.round(value, 4).alias("importance"))


def decayed(memories: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Rows untouched for a week, with their new stability."""
    old = F.col("last_accessed_at") < ago(as_of, days)
    never = F.col("last_accessed_at").isNull() & (F.col("created_at") < ago(as_of, days))
    return memories.where(old | never).select("id", F.greatest(F.lit(0.1), F.col("stability") * 0.95).alias("stability"))


def bundle(memories: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """Both kinds of upkeep in one patch (id, importance, stability), null where a rule leaves a row alone."""
    return importance(memories, links).join(decayed(memories, as_of), "id", "full_outer")


def archivable(memories: DataFrame, as_of: str, k: int, protected: Sequence[str] = PROTECTED, days: int = 30) -> DataFrame:
    old = memories.where("stability < 0.3 and importance < 0.2 and access_count = 0 and category is distinct from '_archived'").where(~F.col("source_type").isin(list(protected)) & (F.col("created_at") < ago(as_of, days)))
    return old.orderBy(F.asc_nulls_last("importance"), F.asc_nulls_last("stability"), "id").limit(k)


def tiers(memories: DataFrame, as_of: str) -> DataFrame:
    """The tier that each row moves to and by which rule; one ordered expression instead of statements in turn."""
    t = F.coalesce("tier", F.lit(2))
    hot = (t > 1) & (F.coalesce(F.col("last_accessed_at") >= ago(as_of, 7), F.lit(False)) | F.coalesce(F.col("quality_score") >= 0.8, F.lit(False)))
    cold = (t == 2) & (F.col("importance") < 0.3) & (F.col("access_count") < 3) & (F.col("created_at") < ago(as_of, 30))
    pin = (F.col("importance") >= 0.9) & (F.col("access_count") >= 10) & (t != 0)
    rule = F.when(pin, "pinned").when(hot, "promoted").when(cold, "demoted")
    return memories.withColumn("rule", rule).where("rule is not null").select("id", t.cast("long").alias("old_tier"), F.expr("case rule when 'pinned' then 0L when 'promoted' then 1L else 3L end").alias("new_tier"), "rule")


def feedback_adjusted(memories: DataFrame, outcomes: DataFrame, least: int = 2) -> DataFrame:
    """Importance moved by the share of useful outcomes, within 0 and 1. Applied again it moves again."""
    ratio = outcomes.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"), F.avg(F.col("was_useful").cast("double")).alias("ratio")).where(F.col("n") >= least)
    moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("importance") + (F.col("ratio") - 0.5) * 0.2))
    return memories.join(ratio, "id").select("id", "n", F.round("ratio", 4).alias("ratio"), F.round(moved, 4).alias("importance"))


def quality_of(specific: Column, actionable: Column, contained: Column) -> Column:
    clamp = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), c))
    return (clamp(specific) + clamp(actionable) + clamp(contained)) / 15.0


def freshness(old: DataFrame, new: DataFrame) -> DataFrame:
    """By url: unchanged if lengths are within a fifth and the first 500 characters equal."""
    both = old.select("url", F.col("content").alias("was")).join(new.select("url", F.col("content").alias("now")), "url")
    ratio = F.length("now") / F.greatest(F.length("was"), F.lit(1))
    return both.select("url", (ratio.between(0.8, 1.2) & (F.left("was", F.lit(500)) == F.left("now", F.lit(500)))).alias("unchanged"))


def patched(memories: DataFrame, patch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Partial update: a null in the patch leaves the old value."""
    p = patch.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    return memories.join(p, "id", "left").select("id", *[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in memories.columns if c != "id"])


def deleted(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame) -> dict[str, DataFrame]:
    """Delete by identifier with its children: every table is given with its reference column."""
    return {name: df.join(keys.select(F.col("id").alias(column)).distinct(), column, "left_anti") for name, (df, column) in tables.items()}


def versions(changes: DataFrame, compared: Sequence[str]) -> DataFrame:
    """A change log (id, at, columns) as numbered versions with what changed; rows that change nothing are none."""
    w = Window.partitionBy("id").orderBy("at")
    flagged = changes
    for c in compared:
        flagged = flagged.withColumn(f"{c}_changed", ~F.col(c).eqNullSafe(F.lag(c).over(w)) & F.lag("at").over(w).isNotNull())
    first = F.lag("at").over(w).isNull()
    any_ = F.lit(False)
    for c in compared:
        any_ = any_ | F.col(f"{c}_changed")
    kept = flagged.withColumn("__first", first).where(any_ | F.col("__first")).drop("__first")
    return kept.withColumn("version", (F.row_number().over(w) - 1).cast("long"))


def restored(memories: DataFrame, history: DataFrame, memory: int, version: int, columns: Sequence[str]) -> DataFrame:
    snapshot = history.where((F.col("id") == memory) & (F.col("version") == version)).select("id", *columns)
    return patched(memories, snapshot, columns)


def audit(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """INSERT, UPDATE or DELETE of each identifier whose row differs, with both rows as JSON."""
    side = lambda df, p: df.select(F.col("id").alias("row_id"), F.struct(*columns).alias(p))
    both = side(before, "old").join(side(after, "new"), "row_id", "full_outer")
    op = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    return both.withColumn("operation", op).where("operation is not null").select("row_id", "operation", F.to_json("old").alias("old_row"), F.to_json("new").alias("new_row"))


def entity_upsert(existing: DataFrame, mentions: DataFrame) -> DataFrame:
    """By canonical name and type: mentions added up, old identifiers and descriptions kept."""
    new = mentions.groupBy(F.lower(F.trim("name")).alias("canonical_name"), "entity_type").agg(F.count("*").alias("n"), F.min("name").alias("new_name"))
    both = existing.select("id", "name", "canonical_name", "entity_type", "mention_count").join(new, ["canonical_name", "entity_type"], "full_outer")
    return both.select("canonical_name", "entity_type", F.coalesce("name", "new_name").alias("name"), (F.coalesce("mention_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("mention_count"), F.col("id").isNull().alias("inserted"))


def link_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The latest confidence of each link."""
    both = existing.select("memory_id", "entity_id", "confidence", F.lit(0).alias("ord")).unionByName(new.select("memory_id", "entity_id", "confidence", F.lit(1).alias("ord")))
    return both.groupBy("memory_id", "entity_id").agg(F.max_by("confidence", F.struct("ord", "confidence")).alias("confidence"))


def relation_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The greatest confidence of each edge."""
    keys = ["source_id", "target_id", "relationship_type"]
    return existing.select(*keys, "confidence").unionByName(new.select(*keys, "confidence")).groupBy(*keys).agg(F.max("confidence").alias("confidence"))


def merged_entities(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with losers replaced by winners (loser, winner); of edges that become equal the least identifier stays."""
    m = lambda p: mapping.select(F.col("loser").alias(f"{p}_id"), F.col("winner").alias(f"{p}_to"))
    moved = relations.join(m("source"), "source_id", "left").join(m("target"), "target_id", "left")
    ends = moved.select("id", F.coalesce("source_to", "source_id").alias("source_id"), F.coalesce("target_to", "target_id").alias("target_id"), "relationship_type", "confidence")
    return ends.groupBy("source_id", "target_id", "relationship_type").agg(F.min("id").alias("id"), F.min_by("confidence", "id").alias("confidence"))


def categories_replaced(memories: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return memories.withColumn("category", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col("category")), F.col("category")))


def handoff_resolved(memories: DataFrame, ids: Sequence[int], resolution: str) -> DataFrame:
    mine = F.col("id").isin(list(ids))
    return memories.withColumn("tags", F.when(mine, F.array_append(F.array_remove("tags", "handoff:in_progress"), f"handoff:{resolution}")).otherwise(F.col("tags")))
