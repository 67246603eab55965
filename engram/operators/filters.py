"""Filters, projections, paging. Sorts state where nulls go and end with the identifier, so that ties are ordered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, tags: Sequence[str] = (), category: str = "", source_type: str = "", source_machine: str = "") -> DataFrame:
    """Any-overlap of tags and equality of the rest; an empty value filters nothing."""
    if tags:
        df = df.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    for name, value in (("category", category), ("source_type", source_type), ("source_machine", source_machine)):
        if value:
            df = df.where(F.col(name) == value)
    return df


def page(df: DataFrame, *order: Column, limit: int = 20, offset: int = 0, most: int = 200) -> DataFrame:
    """A sorted page; the limit is held within 1 and ``most``."""
    return df.orderBy(*order, "id").offset(max(0, offset)).limit(max(1, min(limit, most)))


def newest(df: DataFrame, k: int, offset: int = 0) -> DataFrame:
    return page(df, F.desc("created_at"), limit=k, offset=offset)


def has_terms(column: str, terms: str) -> Column:
    """Whether a text holds every word of ``terms``, lower-cased; without a stemmer, so exact words."""
    words = [w for w in terms.lower().split() if w]
    tokens = F.split(F.lower(F.col(column)), "[^a-z0-9]+")
    return F.lit(bool(words)) if not words else F.size(F.array_except(F.array(*map(F.lit, words)), tokens)) == 0


def structured_query(memories: DataFrame, text: str = "", least_quality: float = 0.0, limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    df = matching(memories, **filters)
    if text:
        df = df.where(has_terms("content", text))
    if least_quality > 0:
        df = df.where(F.col("quality_score") >= least_quality)
    return newest(df, limit, offset)


def by_id(df: DataFrame, value: int) -> DataFrame:
    return df.where(F.col("id") == value)


def looked_up(memories: DataFrame, value: int, as_of: str) -> DataFrame:
    """The snapshot after one row was read: its count is one more and its last access is now."""
    mine = F.col("id") == value
    return memories.withColumns({"access_count": F.when(mine, F.coalesce("access_count", F.lit(0)) + 1).otherwise(F.col("access_count")), "last_accessed_at": F.when(mine, F.lit(as_of).cast("timestamp")).otherwise(F.col("last_accessed_at"))})


def not_archived(df: DataFrame) -> DataFrame:
    """As the comparison does in SQL, rows without a category go too."""
    return df.where("category <> '_archived'")


def unsummarised(memories: DataFrame, k: int) -> DataFrame:
    return page(memories.where("summary is null and length(content) > 50"), F.asc("created_at"), limit=k)


def unscored(memories: DataFrame, k: int) -> DataFrame:
    return newest(not_archived(memories).where("quality_score is null and length(content) > 20"), k)


def unextracted(memories: DataFrame, k: int) -> DataFrame:
    return page(memories.where("extraction_status is null or extraction_status = 'failed'"), F.asc("created_at"), limit=k)


def stale_crawled(memories: DataFrame, as_of: str, days: int, k: int) -> DataFrame:
    old = not_archived(memories).where((F.col("source_type") == "crawl") & (F.col("created_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))))
    return page(old, F.desc_nulls_last("access_count"), F.desc_nulls_last("importance"), limit=k)


def timeline_by_day(memories: DataFrame) -> DataFrame:
    """Rows and first and last identifier of each day."""
    return memories.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def with_all_tags(memories: DataFrame, tags: Sequence[str], as_of: str, hours: int) -> DataFrame:
    wanted = F.array(*map(F.lit, tags))
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    return memories.where((F.size(F.array_intersect("tags", wanted)) == len(set(tags))) & (F.col("created_at") >= since))


def oversized(memories: DataFrame, chars: int) -> DataFrame:
    return memories.where(F.length("content") > chars).groupBy("source_type").agg(F.count("*").alias("n"), F.max(F.length("content")).cast("long").alias("longest"))


def quality_page(memories: DataFrame, least: float, k: int) -> DataFrame:
    return newest(memories.where(F.coalesce("quality_score", F.lit(0.0)) >= least), k)


def shaped(df: DataFrame) -> DataFrame:
    """As rows leave the engine: text identifiers, ISO times, floats of four places."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name == "id" or name.endswith("_id"):
            c = c.cast("string")
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), 4)
        out.append(c.alias(name))
    return df.select(*out)


def unseen(new: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not known. A null key equals nothing, so such rows are always new."""
    return new.join(known.select(*keys).distinct(), list(keys), "left_anti")


def undistilled(conversations: DataFrame, sources: Sequence[str], done: DataFrame, messages: int = 3, chars: int = 200) -> DataFrame:
    """(conv_id, messages) of conversations of some sources, of enough messages and text, that no marker of ``done`` (conv_id) names."""
    mine = conversations.where(F.col("source_type").isin(list(sources))).join(done.select("conv_id").distinct(), "conv_id", "left_anti")
    return mine.groupBy("conv_id").agg(F.count("*").alias("messages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).where((F.col("messages") >= messages) & (F.col("chars") >= chars)).drop("chars")


def waiting(queue: DataFrame, k: int) -> DataFrame:
    """The first ``k`` queue rows that are not crawled yet, first in first out."""
    return queue.where("crawled_at is null").orderBy("queued_at", "id").limit(k)


def tier_set(memories: DataFrame, tiers: DataFrame) -> DataFrame:
    """Memories with the tiers (id, tier) asked for; tiers but 0 to 3 raise an error when a row of the table is named with one."""
    asked = tiers.groupBy("id").agg(F.max("tier").alias("__tier"))
    checked = F.when(F.col("__tier").isNull() | F.col("__tier").between(0, 3), F.coalesce("__tier", "tier")).otherwise(F.raise_error(F.lit("a tier is 0, 1, 2 or 3")).cast("long"))
    return memories.join(asked, "id", "left").withColumn("tier", checked).drop("__tier")
