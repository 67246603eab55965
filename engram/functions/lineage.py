"""Cutting the lineage of iterative plans by tables in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named, one is made on a single machine; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="engram-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_one_by_one(made: Callable[[int], DataFrame], n: int, name: str) -> DataFrame:
    """``cut`` of the union of made(0) to made(n - 1), one after the other, so that only one's shuffles are on disk at a time."""
    root, schema = None, None
    for i in range(n):
        part = made(i)
        spark, schema = part.sparkSession, part.schema
        root = root or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        part.write.mode("append").parquet(root)
        del part
        gc.collect()
        spark._jvm.System.gc()  # what is no longer referred to is cleaned from the disk
    return spark.read.schema(schema).parquet(root)


def cut_in_slices(rows: DataFrame, key: Sequence[str], n: int, then: Callable[[DataFrame], DataFrame], name: str = "slices") -> DataFrame:
    """``cut(then(rows))``, but of one of ``n`` slices of ``rows`` by a hash of ``key`` after the other."""
    if n <= 1:
        return cut(then(rows), name)
    spark, schema = rows.sparkSession, rows.schema
    root = f"{shared_folder(spark)}/{name}-of-{uuid.uuid4().hex}"
    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))
    sliced.repartition(n, "__slice").write.partitionBy("__slice").parquet(root)  # each slice is read once
    path = lambda i: f"{root}/__slice={i}"
    return cut_one_by_one(lambda i: then(spark.read.schema(schema).parquet(path(i)) if _exists(spark, path(i)) else rows.limit(0)), n, name)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
