"""Counts, histograms, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ago(as_of: str, days: float) -> Column:
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(int(days)))


def scalar_counts(memories: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of totals; three one-row aggregates side by side."""
    m = memories.agg(F.count("*").alias("memories"), F.count("embedding").alias("embedded"), F.count_if(F.col("category") == "_archived").alias("archived"), F.count_if(F.col("extraction_status") == "done").alias("extracted"))
    return m.join(entities.agg(F.count("*").alias("entities"))).join(relations.agg(F.count("*").alias("relations")))


def group_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def tag_histogram(memories: DataFrame, k: int | None = None) -> DataFrame:
    counts = memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counts if k is None else counts.orderBy(F.desc("n"), "tag").limit(k)


def model_counts(memories: DataFrame) -> DataFrame:
    """Grouped by the raw value: null is shown as unknown but stays a group of its own."""
    return memories.groupBy("embedding_model").agg(F.count("*").alias("n")).select(F.coalesce("embedding_model", F.lit("unknown")).alias("model"), "n")


def document_counts(memories: DataFrame) -> DataFrame:
    return memories.agg(F.countDistinct(F.when(F.col("chunk_index").isNotNull(), F.col("document_id"))).alias("documents"), F.count_if(F.col("chunk_index").isNotNull()).alias("chunks"))


def tier_counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy(F.coalesce("tier", F.lit(2)).cast("long").alias("tier")).agg(F.count("*").alias("n"))


def feedback_totals(outcomes: DataFrame, memories: DataFrame, as_of: str) -> DataFrame:
    o = outcomes.agg(F.count("*").alias("outcomes"), F.count_if("was_useful").alias("useful"))
    return o.join(memories.agg(F.count_if(F.col("category") == "_archived").alias("archived"), F.count_if(F.col("created_at") >= ago(as_of, 1)).alias("last_day")))


def hot_topics(signals: DataFrame, as_of: str, decay_days: float, k: int | None = None, least: float = 0.1) -> DataFrame:
    """Strength decayed by age over the last three decay periods; all topics, in no order, where k is None."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("created_at")) / 86400e6
    recent = signals.where(F.col("created_at") >= ago(as_of, 3 * decay_days))
    scored = recent.groupBy("topic").agg(F.sum(F.col("strength") * F.exp(-age / decay_days)).alias("score"), F.count("*").alias("n"), F.max("created_at").alias("last"))
    hot = scored.where(F.col("score") > least)
    return hot if k is None else hot.orderBy(F.desc("score"), "topic").limit(k)


def last_seen(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.max("created_at").alias("last"))


def domain_saturation(outcomes: DataFrame, last: int = 20, least: int = 3, novelty: float = 0.2, as_of: str | None = None, days: int = 7) -> DataFrame:
    """By domain: its latest outcomes, of the last ``days`` before ``as_of`` where given, and whether too few of them were new."""
    w = Window.partitionBy("domain").orderBy(F.desc("created_at"), F.desc("id"))
    outcomes = outcomes if as_of is None else outcomes.where(F.col("created_at") >= ago(as_of, days))
    latest = outcomes.where("domain is not null").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    return latest.groupBy("domain").agg(F.count("*").alias("n"), F.avg(F.col("novel").cast("double")).alias("novelty")).withColumn("saturated", (F.col("n") >= least) & (F.col("novelty") < novelty))


def pulse(memories: DataFrame, outcomes: DataFrame, relations: DataFrame, as_of: str) -> DataFrame:
    """Totals, growth, hit rate of a week, mean out-degree."""
    m = memories.agg(F.count("*").alias("memories"), F.count_if(F.col("created_at") >= ago(as_of, 1)).alias("new_in_a_day"), F.countDistinct("source_machine").alias("machines"))
    o = outcomes.where(F.col("created_at") >= ago(as_of, 7)).agg(F.count("*").alias("feedback"), F.round(F.avg(F.col("was_useful").cast("double")), 4).alias("hit_rate"))
    degree = relations.where("valid").groupBy("source_id").count().agg(F.round(F.avg("count"), 4).alias("mean_out_degree"))
    return m.join(o).join(degree)


def event_counts(events: DataFrame) -> DataFrame:
    """One row of counts by kind."""
    kinds = ["error", "task_complete", "decision", "insight_processed", "crawl_outcome"]
    return events.agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.count("*").alias("total"))


def job_runs(events: DataFrame, last: int) -> DataFrame:
    """Last run and runs of each kind among the newest ``last`` events of all."""
    recent = events.orderBy(F.desc("created_at"), F.desc("id")).limit(last)
    return recent.groupBy("event_type").agg(F.max("created_at").alias("last_run"), F.count("*").alias("runs"))


def extension_counts(paths: DataFrame) -> DataFrame:
    """Files by extension and by first folder of a path column."""
    p = paths.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).withColumn("top", F.substring_index("path", "/", 1))
    return p.groupBy("top", "extension").agg(F.count("*").alias("n"))


def pulse_lists(memories: DataFrame, k: int) -> DataFrame:
    """(kind, name, n): the k largest categories, all machines, all models."""
    count = lambda kind, name: memories.select(F.lit(kind).alias("kind"), name.alias("name")).where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"))
    top = count("category", F.col("category")).orderBy(F.desc("n"), "name").limit(k)
    return top.unionByName(count("machine", F.col("source_machine"))).unionByName(count("model", F.coalesce("embedding_model", F.lit("unknown"))))


def briefing(memories: DataFrame, events: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    """(kind, name, n): totals, the k largest categories, the k last events with their moment in microseconds."""
    row = memories.agg(F.count("*").alias("memories"), F.count_if(F.col("created_at") >= ago(as_of, 1)).alias("last_day"))
    totals = row.select(F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in row.columns])).alias("r")).select("r.*")
    top = group_counts(memories.where("category is not null"), "category").orderBy(F.desc("n"), "value").limit(k).select(F.lit("category").alias("kind"), F.col("value").alias("name"), "n")
    last = events.orderBy(F.desc("created_at"), F.desc("id")).limit(k).select(F.lit("event").alias("kind"), F.concat_ws(" ", "event_type", F.col("id").cast("string")).alias("name"), F.unix_micros("created_at").alias("n"))
    return totals.unionByName(top).unionByName(last)


def scheduler_counts(events: DataFrame, memories: DataFrame, entities: DataFrame, as_of: str) -> DataFrame:
    """One row of what was done and what is waiting; three one-row aggregates side by side."""
    kind = F.col("event_type")
    e = events.agg(F.count_if(kind == "error").alias("errors"), F.count_if((kind == "error") & (F.col("created_at") >= ago(as_of, 7))).alias("errors_week"), F.count_if(kind == "task_complete").alias("done"), F.count_if(kind == "insight_processed").alias("processed"))
    status = F.col("extraction_status")
    m = memories.agg(F.count_if(F.col("summary").isNull()).alias("unsummarised"), F.count_if(F.col("quality_score").isNull()).alias("unscored"), F.count_if(status.isNull() | (status == "failed")).alias("unextracted"))
    return e.join(m).join(entities.agg(F.count_if(F.col("description").isNull() | (F.length("description") < 20)).alias("undescribed")))


def path_tree(files: DataFrame) -> DataFrame:
    """(top, second, files) of paths: files by the first two levels of the tree; empty where a path has no such level."""
    part = F.split("path", "/")
    return files.select(F.coalesce(F.get(part, F.lit(0)), F.lit("")).alias("top"), F.coalesce(F.get(part, F.lit(1)), F.lit("")).alias("second")).groupBy("top", "second").agg(F.count("*").alias("files"))
