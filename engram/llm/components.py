"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _stars(edges: DataFrame, small: bool, made: list[DataFrame]) -> DataFrame:
    """One round: connect neighbours to the least node around. Each hub's minimum is a partial aggregate; no group is gathered."""
    if small:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Written, so that the join deals both sides anew and Spark can split a star's centre.
    least = written(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
    made.append(least)
    joined = around.join(least, "u")
    if small:
        moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    else:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) for every node of ``edges`` (a long, b long), as a written table. Loops and repeats do no harm."""
    now = written(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    before = None
    while True:
        # Rounds end when the edges no longer change; a star forest is a fixed point.
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or before == (state.n, state.h):
            found = written(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "cc-roots")
            discard(now)
            return found
        before, last = (state.n, state.h), now
        made: list[DataFrame] = []
        large = written(_stars(now, False, made), "cc-edges")
        now = written(_stars(large, True, made), "cc-edges")
        discard(last, large, *made)
