"""Structured Streaming forms of the time-driven operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of (ts, event_type, value) by window, late rows within the watermark included."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def process_once(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark, instead of marker rows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def unhealthy_alerts(checks: DataFrame, threshold: int) -> DataFrame:
    """(key, at, run): fires when a key's consecutive bad (key, at, healthy) checks reach the threshold; a good one resets.

    The state is one number a key, kept for good; ``watched`` lets silent keys go."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bad = state.get[0] if state.exists else 0
        out = []
        rows = pd.concat(list(parts)).sort_values("at")
        for at, healthy in zip(rows["at"], rows["healthy"]):
            bad = 0 if healthy else bad + 1
            if bad == threshold:
                out.append((key[0], at, bad))
        state.update((bad,))
        yield pd.DataFrame(out, columns=["key", "at", "run"])

    return checks.groupBy("key").applyInPandasWithState(run, "key string, at timestamp, run int", "bad int", "append", GroupStateTimeout.NoTimeout)


def rate_limited(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """(key, at, allowed): a sliding log; at most ``most`` times a key are held as state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        out = []
        for at in pd.concat(list(parts))["at"].sort_values():
            now = at.timestamp()
            log = [t for t in log if t > now - seconds]
            allowed = len(log) < most
            if allowed:
                log.append(now)
            out.append((key[0], at, allowed))
        state.update((log,))
        yield pd.DataFrame(out, columns=["key", "at", "allowed"])

    return requests.groupBy("key").applyInPandasWithState(run, "key string, at timestamp, allowed boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def to_bus(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Micro-batches to a handler, once each; what there is now, then stop."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Watch(StatefulProcessor):
    """Consecutive bad checks, silence, and the end of a key's state, by timers on event time."""

    def __init__(self, threshold: int, silent: float, expire: float):
        self.threshold, self.silent, self.expire = threshold, int(silent * 1000), int(expire * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "bad int, last long, missing boolean")

    def _alarm(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bad, last, missing = self.state.get() if self.state.exists() else (0, 0, False)
        out = []
        checks = pd.concat(list(rows)).sort_values("at")
        for at, healthy in zip(checks["at"], checks["healthy"]):
            now = int(at.timestamp() * 1000)
            if last and not missing and now > last + self.silent:  # rows come before timers: this one's timer has not fired yet
                out.append((key[0], pd.Timestamp(last + self.silent, unit="ms"), "missing", 0))
                missing = True
            if missing:
                out.append((key[0], at, "back", 0))
                missing = False
            bad = 0 if healthy else bad + 1
            if bad == self.threshold:
                out.append((key[0], at, "unhealthy", bad))
            last = max(last, now)
        self.state.update((bad, last, missing))
        self._alarm(last + self.silent)
        yield pd.DataFrame(out, columns=["key", "at", "kind", "run"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bad, last, missing = self.state.get()
        if missing:
            self.state.clear()
            yield pd.DataFrame([], columns=["key", "at", "kind", "run"])
            return
        self.state.update((bad, last, True))
        self.handle.registerTimer(last + self.silent + self.expire)
        yield pd.DataFrame([(key[0], pd.Timestamp(last + self.silent, unit="ms"), "missing", 0)], columns=["key", "at", "kind", "run"])

    def close(self) -> None:
        pass


def watched(checks: DataFrame, threshold: int, silent: float, expire: float, late: str = "0 seconds") -> DataFrame:
    """(key, at, kind, run) of (key, at, healthy) checks: "unhealthy" when a key's consecutive bad checks reach the threshold, "missing" when the watermark has
    passed ``silent`` seconds since its last check, "back" at the next one; after ``expire`` more seconds of silence its state goes.

    State is three numbers and a timer a key, in the RocksDB store, which timers need: the session's store is set to it where it has none."""
    spark = checks.sparkSession
    if spark.conf.get(STORE, "").rsplit(".", 1)[-1] != ROCKS.rsplit(".", 1)[-1]:
        spark.conf.set(STORE, ROCKS)
    rows = checks.withWatermark("at", late).groupBy("key")
    return rows.transformWithStateInPandas(statefulProcessor=Watch(threshold, silent, expire), outputStructType="key string, at timestamp, kind string, run int", outputMode="append", timeMode="EventTime")


def decayed_buckets(signals: DataFrame, decay_days: float, bucket: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(topic, start, weight, n, last): mergeable parts of decayed scores of (topic, strength, created_at).

    Each signal counts as of its bucket's start, so that no update rescales what is held, and adding commutes; a bucket's
    state goes when the watermark has passed it. ``topics_at`` makes scores of any later moment from the parts."""
    start = F.col("w.start")
    grown = F.col("strength") * F.exp((F.unix_micros("created_at") - F.unix_micros(F.window("created_at", bucket)["start"])) / 86400e6 / decay_days)
    parts = signals.withWatermark("created_at", late).withColumn("grown", grown).groupBy("topic", F.window("created_at", bucket).alias("w"))
    return parts.agg(F.sum("grown").alias("weight"), F.count("*").alias("n"), F.max("created_at").alias("last")).select("topic", start.alias("start"), "weight", "n", "last")


def topics_at(buckets: DataFrame, as_of: str, decay_days: float, least: float = 0.1) -> DataFrame:
    """(topic, score, n, last) at a moment, of the buckets of the last three decay periods: what ``stats.hot_topics`` gives where that
    moment lies on a bucket's edge. Of a bucket that was written again, the last state counts."""
    moment = F.unix_micros(F.lit(as_of).cast("timestamp"))
    age = (moment - F.unix_micros("start")) / 86400e6
    last = buckets.groupBy("topic", "start").agg(F.max_by(F.struct("weight", "n", "last"), F.struct("n", "last")).alias("s")).select("topic", "start", "s.*")
    held = last.where((age <= 3 * decay_days) & (age > 0))
    return held.groupBy("topic").agg(F.sum(F.col("weight") * F.exp(-age / decay_days)).alias("score"), F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("score") > least)
