"""Change capture of a stream of row states: numbered versions and an audit trail, each change once.

``ChangeCapture`` is a ``foreachBatch`` handler over (key, at, columns, and deleted, if there is such a column). Below its folder it keeps

- ``audit/batch=n``: one row a change: key, at, operation (INSERT, UPDATE, DELETE), version, both rows as JSON, which columns changed;
- ``state/batch=n``: the last state of every key that batch n named, with its version;
- ``base/batch=n``: the states of all keys up to batch n, written every ``merge_every`` batches, so that few tables are read.

A batch is compared only with what batches before it have left, and writes its own folders anew, so that a batch that is run again, after a
failure or a replay, leaves the same rows once. Only the states of a batch's keys are joined; nothing is gathered by hand.

Defined cases: rows of a key within a batch follow one another by ``at``, then by their values; a row equal to its predecessor is no change; null and
value differ; a deletion of a key that is not there is no change; a key that comes back goes on with the next version; rows older than the stored
state are taken as they come; rows without a key are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ChangeCapture:
    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], key: str = "id", at: str = "at", merge_every: int = 16):
        self.spark, self.path, self.columns, self.key, self.at, self.merge_every = spark, path.rstrip("/"), list(columns), key, at, merge_every

    def _batches(self, name: str) -> list[int]:
        """Finished tables only: the writer leaves a mark when it is done."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        done = lambda f: store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
        return sorted(int(f.getPath().getName()[6:]) for f in store.listStatus(folder) if f.getPath().getName().startswith("batch=") and done(f))

    def state(self, before: int | None = None, base_before: int | None = None) -> DataFrame | None:
        """key, version, deleted, at and columns: the last state of every key, of the batches before one or of all, on a base of before ``base_before``."""
        inside = lambda b: before is None or b < before
        base = [b for b in self._batches("base") if inside(b) and (base_before is None or b < base_before)][-1:]
        late = [b for b in self._batches("state") if inside(b) and (not base or b > base[0])]
        parts = [f"{self.path}/base/batch={b}" for b in base] + [f"{self.path}/state/batch={b}" for b in late]
        if not parts:
            return None
        rows = self.spark.read.parquet(*parts)
        return rows if len(parts) == 1 else rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != self.key]), "version").alias("s")).select(self.key, "s.*")

    def __call__(self, batch: DataFrame, number: int) -> None:
        new = batch.where(F.col(self.key).isNotNull())
        new = new.select(self.key, self.at, (F.coalesce("deleted", F.lit(False)) if "deleted" in new.columns else F.lit(False)).alias("deleted"), *self.columns, F.lit(1).alias("late"), F.lit(None).cast("long").alias("version"))
        old = self.state(number)
        if old is not None:
            mine = old.join(new.select(self.key).distinct(), self.key, "left_semi")
            new = new.unionByName(mine.select(self.key, self.at, "deleted", *self.columns, F.lit(0).alias("late"), "version"))
        order = Window.partitionBy(self.key).orderBy("late", self.at, "deleted", *self.columns)
        row = F.struct(*self.columns)
        here = F.when(~F.col("deleted"), row)  # null: not there
        marked = new.withColumn("row", here).withColumn("before", F.lag("row").over(order))
        changed = marked.withColumn("operation", F.when(F.col("before").isNull() & F.col("row").isNotNull(), "INSERT").when(F.col("before").isNotNull() & F.col("row").isNull(), "DELETE").when(~F.col("before").eqNullSafe(F.col("row")), "UPDATE"))
        kept = changed.where("late = 0 or operation is not null")
        first = F.max("version").over(Window.partitionBy(self.key))
        numbered = kept.withColumn("version", F.coalesce(first, F.lit(-1)) + F.sum("late").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        which = F.filter(F.array(*[F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"row.{c}")), c) for c in self.columns]), lambda c: c.isNotNull())
        audit = numbered.where("late = 1").select(self.key, self.at, "operation", "version", F.to_json("before").alias("old_row"), F.to_json("row").alias("new_row"), which.alias("changed"))
        audit.write.mode("overwrite").parquet(f"{self.path}/audit/batch={number}")
        # An unchanged key keeps its version, so that reading it again from this batch is the same.
        last = numbered.groupBy(self.key).agg(F.max_by(F.struct("version", "deleted", self.at, *self.columns), "version").alias("s")).select(self.key, "s.*")
        last.write.mode("overwrite").parquet(f"{self.path}/state/batch={number}")
        if (number + 1) % self.merge_every == 0:
            self.state(number + 1, number).write.mode("overwrite").parquet(f"{self.path}/base/batch={number}")

    def audit(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/audit/batch={b}" for b in self._batches("audit")])

    def versions(self, key=None) -> DataFrame:
        """The states that changes have left, newest first: of one key, or of all."""
        rows = self.audit().where("operation <> 'DELETE'")
        return (rows if key is None else rows.where(F.col(self.key) == key)).orderBy(self.key, F.desc("version"))

    def start(self, stream: DataFrame, checkpoint: str):
        """Capture what there is now, then stop."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
