"""The corpus pipeline: five stages, each on all that the one before kept.

Every stage but the last returns the columns of documents; ``run`` writes each stage's rows to the shared
folder and reads them again, so that a lost executor costs one stage at most, and then removes the tables
that the stage made for itself, and its input if an earlier stage wrote it.

Defined cases, for every stage: an empty table gives an empty one; null identifiers and repeated rows are
rows like others; a null text is an empty one to all decisions and stays null; extra columns go through
all but the last stage unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import collecting, discard, read_table, remove, sifted, written
from engram.llm.near import near_duplicates
from engram.llm.packing import pack
from engram.llm.quality import fit_quality, keep_quality
from engram.llm.queries import tokenizer_path
from engram.llm.secrets import redact_secrets
from engram.llm.suffix import remove_repeats

ORACLE_SQL = None  # a trained model's scores and BPE are beyond SQL; tests hold the stages against brute force

#: Bytes of a repeated passage: under what 50 words take.
PASSAGE, STEP = 200, 50


def counted(docs: DataFrame) -> DataFrame:
    """n_chars as of the text that is left; null stays null."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else docs


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from labelled rows of this stage's input."""
    return keep_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: five-word shingles, similarity 0.8.

    Groups are of rows, numbered as written, so that null and repeated identifiers are rows like others."""
    mark = unused("row", docs.columns)
    rows = written(docs.withColumn(mark, F.monotonically_increasing_id()), "pipeline-rows")
    found = near_duplicates(rows.select(F.col(mark).alias("doc_id"), "text"))
    gone = written(found.where("not kept").select(F.col("doc_id").alias("key")), "pipeline-gone")
    choose = sifted(rows, F.col(mark), gone)
    left = choose(True).join(gone.withColumnRenamed("key", mark), mark, "left_anti")
    return left.unionByName(choose(False)).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur more than once go; every document stays, some with less text."""
    return counted(remove_repeats(docs, PASSAGE, STEP))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return counted(redact_secrets(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces of sequences of at most 1024 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("repeats", cut_repeats), ("secrets", hide_secrets), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with collecting() as made:
            docs = stage(spark, before, sf_dir)
        docs = written(docs, f"pipeline-{name}")
        discard(before)
        for path in made:
            remove(spark, path)
    return docs
