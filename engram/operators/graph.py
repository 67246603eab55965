"""Bounded traversal, components, communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .louvain import moved_by, packed_rows, proposing_rows, settle_rows


def symmetric(relations: DataFrame) -> DataFrame:
    e = relations.where("valid")
    return e.select("id", F.col("source_id").alias("u"), F.col("target_id").alias("v")).unionByName(e.select("id", F.col("target_id").alias("u"), F.col("source_id").alias("v")))


def neighbourhood(relations: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(edge_id, id, depth): edges reached from the start and the least depth, over valid edges either way."""
    edges = symmetric(relations)
    frontier = start.select(F.col("id").alias("u")).distinct()
    seen, found = frontier, None
    for d in range(1, depth + 1):
        step = frontier.join(edges, "u").select(F.col("id").alias("edge_id"), F.col("v").alias("id"), F.lit(d).alias("depth"))
        found = step if found is None else found.unionByName(step)
        if d < depth:
            frontier = cut(step.select(F.col("id").alias("u")).distinct().join(seen, "u", "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
    w = Window.partitionBy("edge_id").orderBy("depth", "id")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def bounded_neighbourhoods(relations: DataFrame, starts: DataFrame, depth: int, most: int = 50) -> DataFrame:
    """(start, id, depth): for every (start, id) of ``starts`` the nodes around its ids, over valid edges either way, ``most`` of a start besides those at depth 0.

    All starts go on at once, a round a depth; in each, a start takes its new nodes by identifier until it is full. Of a node's neighbours only the
    first 2 most + s can ever be taken, s the start's own ids, since a start has seen most + s nodes at most: the rest of a hub's edges is left out before any join."""
    own = starts.select("start", "id").distinct()
    largest = own.groupBy("start").count().agg(F.max("count")).first()[0] or 0
    order = Window.partitionBy("u").orderBy("v")
    near = symmetric(relations).select("u", "v").where("u <> v").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * most + largest).drop("n")
    near = cut(near, "neighbours")
    seen = own.withColumn("depth", F.lit(0))
    frontier = own
    for d in range(1, depth + 1):
        room = seen.groupBy("start").agg((most - F.count_if(F.col("depth") > 0)).alias("room"))
        step = frontier.join(near, frontier["id"] == near["u"]).select("start", F.col("v").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        ranked = step.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("id"))).where(F.col("n") <= most)
        frontier = cut(ranked.join(room, "start").where("n <= room").select("start", "id"), "frontier")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over (a, b) edges. Least labels spread and pointers jump, round by round."""
    e = edges.where("a <> b").distinct()
    both = cut(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        lower = label.join(near, "node").select("node", F.least("component", "c").alias("c"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        after = cut(lower.join(jump, "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("component")), "labels")
        if not label.join(after.withColumnRenamed("component", "new"), "node").where("component <> new").take(1):
            return after
        label = after


def degrees(relations: DataFrame) -> DataFrame:
    return symmetric(relations).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))


def weights(relations: DataFrame) -> DataFrame:
    """(a, b, w), a < b: confidences of parallel and reverse edges added up; none or zero counts one."""
    c = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    return relations.where("valid and source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), c.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


#: Graphs of so many pairs and nodes are settled in one task; labels of so many nodes are held by the driver and sent to the tasks.
PAIRS, NODES, LABELS = 1 << 22, 1 << 18, 1 << 21


def communities(relations: DataFrame, rounds: int | None = None, least: int = 3) -> DataFrame:
    """(node, community): local moves that raise modularity, then the same on contracted communities, after Blondel and others, 2008.

    Rounds of moves end when no node gains (or after ``rounds`` of a level, where given), levels when none
    of their nodes does. Ties go to the lesser community. Small communities go.

    While a level has more than ``PAIRS`` pairs or ``NODES`` nodes, its edges stay in many tasks and a round is one pass over them that knows all labels; with over
    ``LABELS`` nodes, labels are joined. What contraction leaves under these bounds is settled in one task, whose memory they bound."""
    pairs = cut(weights(relations), "weights")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    strength = cut(both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")), "strength")
    members = strength.select("node", F.col("node").alias("community"))
    n, total = pairs.agg(F.count("*"), F.sum("w")).first()
    while n:
        nodes = strength.count()
        if here := n <= PAIRS and nodes <= NODES:
            # The rows of strengths name the nodes. All levels that follow are settled at once.
            rows = pairs.select("a", "b", "w").unionByName(strength.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("k").alias("w")))
            label = cut(rows.coalesce(1).mapInArrow(settle_rows(total, rounds), "node long, community long"), "settled")
        elif nodes <= LABELS:
            label = _moved_by_labels(pairs, strength, total, rounds)
        else:
            label = _moved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), strength, total, rounds)
        if label is None:
            break
        named = label.select(F.col("node").alias("community"), F.col("community").alias("joined"))
        members = cut(members.join(named, "community", "left").select("node", F.coalesce("joined", "community").alias("community")), "communities")
        if here:
            break
        ends = lambda end: label.select(F.col("node").alias(end), F.col("community").alias(f"{end}_in"))  # noqa: E731, B023
        linked = pairs.join(ends("a"), "a").join(ends("b"), "b").where("a_in <> b_in")
        pairs = cut(linked.groupBy(F.least("a_in", "b_in").alias("a"), F.greatest("a_in", "b_in").alias("b")).agg(F.sum("w").alias("w")), "contracted")
        named = label.select("node", F.col("community").alias("joined"))
        strength = cut(strength.join(named, "node", "left").groupBy(F.coalesce("joined", "node").alias("node")).agg(F.sum("k").alias("k")), "strength")
        n = pairs.count()
    sizes = members.groupBy("community").agg(F.count("*").alias("members"), F.min("node").alias("least")).where(F.col("members") >= least)
    return members.join(sizes, "community").select("node", F.col("least").alias("community"), "members")


def _moved_by_labels(pairs: DataFrame, strength: DataFrame, total: float, rounds: int | None) -> DataFrame | None:
    """(node, community) when no node gains any more, or None where none gains from the start: edges packed by node once, then a pass over them a round."""
    spark = pairs.sparkSession
    rows = strength.select(F.col("node").cast("long").alias("node"), "k").toArrow()  # LABELS rows at most
    ids, k = rows.column("node").to_numpy(), rows.column("k").to_numpy()
    order = np.argsort(ids)
    ids, k = ids[order], k[order]
    known = spark.sparkContext.broadcast(ids)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (pa.array(np.searchsorted(known.value, batch.column(i).to_numpy()).astype(np.int32)) for i in (0, 1))
            w = batch.column(2)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([b, a]), pa.concat_arrays([w, w])], ["a", "b", "w"])

    both = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "w").mapInArrow(numbered, "a int, b int, w double")
    packed = cut(both.repartition("a").sortWithinPartitions("a", "b").mapInArrow(packed_rows, "a int, near binary, w binary"), "neighbours")

    def propose(label: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, ...]:
        state = spark.sparkContext.broadcast((label, sigma, k))
        got = packed.mapInArrow(proposing_rows(state, total), "node int, best int, gain double, stay double, inside double").toArrow()
        state.unpersist()
        node = got.column("node").to_numpy()
        # A node without a pair stays where it is.
        best, gain, stay, inside = label.copy(), np.zeros(len(k)), np.zeros(len(k)), np.zeros(len(k))
        for x, name in ((best, "best"), (gain, "gain"), (stay, "stay"), (inside, "inside")):
            x[node] = got.column(name).to_numpy()
        return best, gain, stay, inside

    label = moved_by(propose, k, total, rounds)
    if label is None:
        return None
    name = ids[label]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, name = shared.value
        for batch in batches:
            node = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(name[np.searchsorted(ids, node)])], ["node", "community"])

    shared = spark.sparkContext.broadcast((ids, name))
    return cut(strength.select(F.col("node").cast("long").alias("node")).mapInArrow(told, "node long, community long"), "labels")


def _moved(both: DataFrame, strength: DataFrame, total: float, rounds: int | None) -> DataFrame | None:
    """(node, community) of linked nodes when none gains any more, or None where none gains from the start.

    In each round all nodes of a share of a hash move at once; should that not raise modularity, as when
    neighbours swap, fewer do, and at last only moves no two of which touch one community: their gains add
    up, so that every round raises modularity and the rounds end."""

    def weighed(label: DataFrame) -> tuple[DataFrame, float, int]:
        """Each node's best move, the part of modularity that moves change, and how many nodes gain."""
        size = label.groupBy("community").agg(F.sum("k").alias("sigma"))
        own = label.join(size, "community").select("node", F.col("community").alias("now"), "k", F.col("sigma").alias("sigma_now"))
        links = both.join(label.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("inside"))
        here = F.col("community") == F.col("now")
        gain = links.join(own, "node").join(size, "community").withColumn("gain", F.col("inside") - F.col("k") * (F.col("sigma") - F.when(here, F.col("k")).otherwise(0.0)) / (2 * total))
        stay = F.coalesce(F.max(F.when(here, F.col("gain"))), F.first(-F.col("k") * (F.col("sigma_now") - F.col("k")) / (2 * total)))
        best = gain.groupBy("node", "now", "k", "sigma_now").agg(F.max_by("community", F.struct("gain", (-F.col("community")).alias("t"))).alias("best"), F.max("gain").alias("gain"), stay.alias("stay"), F.sum(F.when(here, F.col("inside")).otherwise(0.0)).alias("inside"))
        step = cut(best.withColumn("moves", (F.col("best") != F.col("now")) & (F.col("gain") > F.col("stay") + 1e-9 * total)), "moves")
        row = step.agg(F.sum(F.col("inside") - F.col("k") * F.col("sigma_now") / (2 * total)).alias("q"), F.count_if("moves").alias("n")).first()
        return step, row.q or 0.0, row.n

    def apart(step: DataFrame) -> DataFrame:
        """The moves that gain most in both communities that they touch."""
        moves = step.where("moves").select("node", "now", "best", F.struct(F.col("gain") - F.col("stay"), -F.col("node")).alias("rank"))
        top = moves.select(F.explode(F.array("now", "best")).alias("c"), "node", "rank").groupBy("c").agg(F.max_by("node", "rank").alias("node"))
        alone = moves.join(top, ["node"]).groupBy("node").agg(F.count("*").alias("tops")).where("tops = 2").select("node", F.lit(True).alias("chosen"))
        return step.drop("moves").join(alone, "node", "left").withColumn("moves", F.coalesce("chosen", F.lit(False)))

    step, q, n = weighed(strength.select("node", F.col("node").alias("community"), "k"))
    if not n:
        return None
    made, tries = 0, 0
    while n and (rounds is None or made < rounds):
        for share in (2, 8, None):
            tries += 1
            chosen = apart(step) if share is None else step.withColumn("moves", F.col("moves") & (F.pmod(F.xxhash64("node", F.lit(tries)), F.lit(share)) == 0))
            after = weighed(chosen.select("node", F.when(F.col("moves"), F.col("best")).otherwise(F.col("now")).alias("community"), "k"))
            if after[1] > q:
                break
        else:  # what is left to gain is lost in rounding
            break
        (step, q, n), made = after, made + 1
    return step.select("node", F.col("now").alias("community"))


def large_components(components: DataFrame, least: int) -> DataFrame:
    """Nodes of components of at least ``least`` nodes; of all, if no component has so many."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n").alias("most"))
    kept = sizes.join(F.broadcast(most)).where(F.col("n") >= F.least(F.lit(least), F.when(F.col("most") >= least, F.lit(least)).otherwise(F.lit(0)))).select("component")
    return components.join(kept, "component", "left_semi")
