"""Streams with expiring state: silence, decayed scores; change capture once, also after a replay."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from engram.operators import maintain, stats
from engram.streaming import stateful
from engram.streaming.capture import ChangeCapture

T0 = datetime(2024, 1, 1)


def files(spark, path, batches, schema):
    """One file a micro-batch, oldest first."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def drained(df, name, spark, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    progress = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    return spark.table(name).collect(), progress


def test_silence_is_noticed_and_state_expires(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[("a", at(0), True), ("b", at(0), False), ("b", at(1), False)], [("b", at(2), False), ("b", at(3), True)], [("b", at(20), True)], [("a", at(21), True), ("b", at(22), True)], [("b", at(60), True)], [("b", at(120), True)], [("b", at(121), True)]]
    stream = files(spark, tmp_path / "in", batches, "key string, at timestamp, healthy boolean")
    before = spark.conf.get(stateful.STORE)
    try:
        rows, held = drained(stateful.watched(stream, 3, 600, 1200), "watch", spark, tmp_path)
    finally:
        spark.conf.set(stateful.STORE, before)
    told = [(r.key, r.at, r.kind) for r in sorted(rows, key=lambda r: (r.key, r.at))]
    assert ("b", at(2), "unhealthy") in told
    assert [x for x in told if x[0] == "a"] == [("a", at(10), "missing"), ("a", at(21), "back"), ("a", at(31), "missing")]
    assert held[-1] < max(held)  # a's state has gone


def test_decayed_scores_equal_the_batch(spark, tmp_path):
    rows = [(f"t{i % 4}", float(1 + i % 5), T0 + timedelta(minutes=37 * i)) for i in range(600)]
    schema = "topic string, strength double, created_at timestamp"
    stream = files(spark, tmp_path / "in", [rows[:200], rows[200:400], rows[400:]], schema)
    out, held = drained(stateful.decayed_buckets(stream, 2.0), "decay", spark, tmp_path, "update")
    buckets = spark.createDataFrame(out, "topic string, start timestamp, weight double, n long, last timestamp")
    as_of = (T0 + timedelta(hours=371)).strftime("%Y-%m-%d %H:%M:%S")
    want = {r.topic: r for r in stats.hot_topics(spark.createDataFrame(rows, schema), as_of, 2.0).collect()}
    got = {r.topic: r for r in stateful.topics_at(buckets, as_of, 2.0).collect()}
    assert set(got) == set(want) and all(abs(got[t].score - want[t].score) < 1e-9 and got[t].n == want[t].n and got[t]["last"] == want[t]["last"] for t in want)
    assert held[-1] < len({(r.topic, r.start) for r in out}) / 2  # old buckets have gone from the state


SCHEMA = "id long, at timestamp, content string, category string, deleted boolean"


def changes():
    at = lambda m: T0 + timedelta(minutes=m)
    return [
        [(1, at(0), "one", "x", False), (2, at(0), "two", None, False), (1, at(1), "one", "x", False), (None, at(1), "none", "x", False)],
        [(1, at(2), "uno", "x", False), (1, at(3), "uno", "y", False), (2, at(2), "two", None, False), (9, at(2), None, None, True)],
        [(2, at(4), None, None, True), (3, at(4), "three", "z", None)],
        [(2, at(5), "deux", "x", False)],
    ]


def told(capture):
    return sorted((r.id, r.version, r.operation, json.loads(r.old_row or "null"), json.loads(r.new_row or "null"), tuple(r.changed)) for r in capture.audit().collect())


WANT = [
    (1, 0, "INSERT", None, {"content": "one", "category": "x"}), (1, 1, "UPDATE", {"content": "one", "category": "x"}, {"content": "uno", "category": "x"}), (1, 2, "UPDATE", {"content": "uno", "category": "x"}, {"content": "uno", "category": "y"}),
    (2, 0, "INSERT", None, {"content": "two"}), (2, 1, "DELETE", {"content": "two"}, None), (2, 2, "INSERT", None, {"content": "deux", "category": "x"}), (3, 0, "INSERT", None, {"content": "three", "category": "z"}),
]


def test_change_capture(spark, tmp_path):
    stream = files(spark, tmp_path / "in", changes(), SCHEMA)
    capture = ChangeCapture(spark, f"file://{tmp_path}/log", ["content", "category"], merge_every=2)
    capture.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert [x[:5] for x in told(capture)] == WANT
    assert [x[5] for x in told(capture)][1:3] == [("content",), ("category",)]
    # A replay of every batch, in order, leaves the same rows once; so does one that a lost driver leaves half done.
    for n, rows in enumerate(changes()):
        capture(spark.createDataFrame(rows, SCHEMA), n)
    assert [x[:5] for x in told(capture)] == WANT
    capture(spark.createDataFrame(changes()[3], SCHEMA), 3)
    assert [x[:5] for x in told(capture)] == WANT
    now = {r.id: (r.version, r.deleted, r.content) for r in capture.state().collect()}
    assert now == {1: (2, False, "uno"), 2: (2, False, "deux"), 3: (0, False, "three"), **({9: now[9]} if 9 in now else {})}
    assert [r.version for r in capture.versions(1).collect()] == [2, 1, 0]


def test_capture_equals_batch_versions(spark, tmp_path):
    rows = [(i % 7, T0 + timedelta(minutes=i), f"c{(i * i) % 3}", None if i % 5 else "k") for i in range(120)]
    schema = "id long, at timestamp, content string, category string"
    capture = ChangeCapture(spark, f"file://{tmp_path}/log", ["content", "category"], merge_every=3)
    for n in range(6):
        capture(spark.createDataFrame(rows[20 * n : 20 * n + 20], schema), n)
    want = {(r.id, r.version, r.content, r.category) for r in maintain.versions(spark.createDataFrame(rows, schema), ["content", "category"]).collect()}
    got = {(r.id, r.version, r.n.content, r.n.category) for r in capture.audit().withColumn("n", F.from_json("new_row", "content string, category string")).collect()}
    assert got == want
