"""Sequences: message windows, counters, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def message_windows(messages: DataFrame, size: int = 8, step: int = 6, least: int = 3) -> DataFrame:
    """(conv_id, window, first_turn, n, text) over user and assistant turns: windows of ``size`` turns every ``step``."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    spoken = messages.where("role in ('user', 'assistant') and text is not null").withColumn("p", F.row_number().over(w) - 1).withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id")))
    kept = spoken.where(F.col("n_turns") >= least)
    short = F.when(F.length("text") > 2000, F.concat(F.left("text", F.lit(1800)), F.lit("..."))).otherwise(F.col("text"))
    # A turn at place p lies in windows k with step * k <= p < step * k + size, of those that start before the end.
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - size + 1) / step).cast("int"))
    placed = kept.withColumn("line", F.concat_ws(": ", "role", short)).withColumn("window", F.explode(F.sequence(first, F.floor(F.col("p") / step).cast("int"))))
    return placed.groupBy("conv_id", "window").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda s: s["line"]), "\n").alias("text"))


def consecutive(checks: DataFrame, threshold: int) -> DataFrame:
    """Moments at which the run of bad checks of a key reaches the threshold: gaps and islands."""
    w = Window.partitionBy("key").orderBy("at", "id")
    island = checks.withColumn("island", F.sum(F.when(F.col("healthy"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bad = island.where("not healthy").withColumn("run", F.row_number().over(Window.partitionBy("key", "island").orderBy("at", "id")))
    return bad.where(F.col("run") == threshold).select("key", "id", F.col("run").cast("long").alias("run"))


def over_limit(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """Requests with more than ``most`` in the trailing time, themselves included."""
    w = Window.partitionBy("key").orderBy("s").rangeBetween(-seconds + 1, 0)
    return requests.withColumn("s", F.unix_seconds("at")).withColumn("recent", F.count("*").over(w)).where(F.col("recent") > most).select("id", "key", "recent")


def missing(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.select("key").distinct().join(now.select("key").distinct(), "key", "left_anti")
