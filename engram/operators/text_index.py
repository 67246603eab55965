"""Ranked full-text search over an inverted index with positions.

``TextIndex.build`` writes, below a folder of the shared store,

- ``postings``: (term, id, positions, size): where each stem stands in each text, counted in words from 1, stop words counted but not
  kept; dealt by range of term and identifier and sorted, so that a search reads only the row groups of its terms and a term
  that every text holds takes many files;
- ``payload``: the columns that filters and orders need, by identifier.

``search`` parses a question: words are joined by and; "quoted words" must follow one another at the distances that they have in the question; or
joins alternatives; -word or -"words" must not occur. Stop words are left out, as in the texts. It reads the postings of the question's terms
(pushed down to the scan), gathers them by text (a text's lists are bounded by itself), tests the question on them, and ranks.

The rank is that of PostgreSQL's ``ts_rank`` with default weights, in doubles. Words joined by and alone, or a single phrase, rank by how
near their places lie: each pair of places of two terms at distance d adds w = sqrt(0.01 / (1.005 + 0.05 exp(d / 1.5 - 2))), next to nothing
beyond 100 words, and the rank is 1 - product(1 - w). Questions with an or, and those of one term, rank by occurrences: each term adds 0.1 times the sum of
1 / j^2 over its places, over pi^2 / 6; the rank is their sum over the number of terms. Stems are Porter's.

``add`` and ``remove`` append; a text counts in its last version. Defined cases: null and empty texts have no postings; a question of stop words
alone, or of nothing but banned words, finds nothing; equal ranks are ordered by the payload's order, then by identifier.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..functions.stems import STOP_WORDS, stem

WORD = re.compile("[a-z0-9]+")
FAR = 100


@dataclass
class Question:
    """Groups of alternatives, all of which must hold, and phrases that must not; a phrase is (term, offset) pairs."""

    groups: list[list[tuple[tuple[str, int], ...]]] = field(default_factory=list)
    banned: list[tuple[tuple[str, int], ...]] = field(default_factory=list)

    @property
    def wanted(self) -> list[str]:
        """The terms that rank, each once."""
        return sorted({t for g in self.groups for p in g for t, _ in p})

    @property
    def terms(self) -> list[str]:
        return sorted({*self.wanted, *(t for p in self.banned for t, _ in p)})

    @property
    def near(self) -> bool:
        """Whether the rank is by nearness: no alternatives, two terms at least."""
        return all(len(g) == 1 for g in self.groups) and len(self.wanted) > 1


def phrase_of(text: str) -> tuple[tuple[str, int], ...]:
    words = WORD.findall(text)
    kept = [(stem(w), i) for i, w in enumerate(words) if w not in STOP_WORDS]
    return tuple((t, i - kept[0][1]) for t, i in kept)


def parsed(question: str) -> Question:
    out, joined = Question(), False
    for part in re.findall(r'-?"[^"]*"?|\S+', question.lower()):
        if part == "or":
            joined = bool(out.groups)
            continue
        phrase = phrase_of(part)
        if not phrase:
            continue
        if part.startswith("-"):
            out.banned.append(phrase)
        elif joined:
            out.groups[-1].append(phrase)
        else:
            out.groups.append([phrase])
        joined = False
    return out


def postings_of(texts: DataFrame, key: str, content: str) -> DataFrame:
    """term, id, positions, size: whole texts, in Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term: list[str] = []
            row, count, flat, size = [], [], [], []

            def out() -> pa.RecordBatch:
                ends = pa.array(np.concatenate([[0], np.cumsum(np.array(count, np.int64))]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))
                made = pa.RecordBatch.from_arrays([pa.array(term, pa.string()), b.column(0).take(pa.array(row, pa.int64())), lists, pa.array(size, pa.int64())], ["term", key, "positions", "size"])
                for x in (term, row, count, flat, size):
                    x.clear()
                return made

            for i, text in enumerate(b.column(1).to_pylist()):
                places: dict[str, list[int]] = {}
                words = WORD.findall((text or "").lower())
                for at, w in enumerate(words, 1):
                    if w not in STOP_WORDS:
                        places.setdefault(stem(w), []).append(at)
                for t, p in places.items():
                    term.append(t)
                    count.append(len(p))
                    flat += p
                row += [i] * len(places)
                size += [len(words)] * len(places)
                if len(flat) > 500_000:
                    yield out()
            if term:
                yield out()

    return texts.select(key, content).mapInArrow(run, f"term string, `{key}` {dict(texts.dtypes)[key]}, positions array<int>, size long")


def nearness(a: Column, b: Column) -> Column:
    """The product of 1 - w over all pairs of places within FAR words; those beyond change nothing that a double holds in practice."""

    def against(x: Column) -> Column:
        close = F.filter(b, lambda y: (F.abs(x - y) <= FAR) & (x != y))
        return F.aggregate(close, F.lit(1.0), lambda s, y: s * (1 - F.sqrt(0.01 / (1.005 + 0.05 * F.exp(F.abs(x - y) / 1.5 - 2)))))

    return F.aggregate(a, F.lit(1.0), lambda s, x: s * against(x))


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def build(cls, texts: DataFrame, path: str | None = None, key: str = "id", content: str = "content", payload: Sequence[str] = ()) -> TextIndex:
        """Write the postings of ``texts`` and their ``payload`` columns. Without ``path``, a new folder of the shared store."""
        spark = texts.sparkSession
        self = cls(spark, path or f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}", key)
        self._write(texts, 0, content, payload)
        return self

    def _write(self, texts: DataFrame, batch: int, content: str, payload: Sequence[str]) -> None:
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        postings_of(texts, self.key, content).repartitionByRange(parts, "term", self.key).sortWithinPartitions("term", self.key).write.parquet(f"{self.path}/postings/batch={batch}")
        texts.select(self.key, *payload).write.parquet(f"{self.path}/payload/batch={batch}")

    def _batches(self, name: str) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()[6:]) for f in store.listStatus(folder) if f.getPath().getName().startswith("batch=")) if store.exists(folder) else []

    def add(self, texts: DataFrame, content: str = "content", payload: Sequence[str] = ()) -> None:
        """Add texts, or replace those of the same identifiers."""
        batch = max([*self._batches("payload"), *self._batches("gone")]) + 1
        texts.select(self.key).distinct().write.parquet(f"{self.path}/gone/batch={batch}")
        self._write(texts, batch, content, payload)

    def remove(self, keys: DataFrame) -> None:
        batch = max([*self._batches("payload"), *self._batches("gone")]) + 1
        keys.select(self.key).distinct().write.parquet(f"{self.path}/gone/batch={batch}")

    def _read(self, name: str) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/batch={b}" for b in self._batches(name)])
        if not (late := self._batches("gone")):
            return rows
        gone = self.spark.read.option("basePath", f"{self.path}/gone").parquet(*[f"{self.path}/gone/batch={b}" for b in late]).groupBy(F.col(self.key).alias("gone_key")).agg(F.max("batch").alias("until"))
        return rows.join(gone, (F.col(self.key) == F.col("gone_key")) & (F.col("batch") < F.col("until")), "left_anti")

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """The lists of some terms; the scan reads only row groups that can hold them."""
        return self._read("postings").where(F.col("term").isin(list(terms))).drop("batch")

    def matches(self, question: str | Question) -> DataFrame:
        """(id, size, rank_score) of every text that the question finds."""
        q = parsed(question) if isinstance(question, str) else question
        if not q.groups:
            return self._read("payload").limit(0).select(self.key, F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("rank_score"))
        lists = self.postings(q.terms)
        # One column a term: its places in the text, null without. A text has one list a term.
        texts = lists.groupBy(self.key).agg(F.max("size").alias("size"), *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"at {t}") for t in q.terms])

        def holds(phrase: tuple[tuple[str, int], ...]) -> Column:
            first, *rest = phrase
            if not rest:
                return F.col(f"at {first[0]}").isNotNull()
            here = F.exists(F.col(f"at {first[0]}"), lambda p: _all([F.array_contains(F.col(f"at {t}"), p + F.lit(o)) for t, o in rest]))
            return F.coalesce(here, F.lit(False))

        good = _all([_any([holds(p) for p in g]) for g in q.groups]) & ~_any([holds(p) for p in q.banned])
        found = texts.where(good)
        at = lambda t: F.coalesce(F.col(f"at {t}"), F.array().cast("array<int>"))
        if q.near:
            left = F.lit(1.0)
            for i, a in enumerate(q.wanted):
                for b in q.wanted[:i]:
                    left = left * nearness(at(a), at(b))
            rank = F.greatest(1 - left, F.lit(1e-20))
        else:
            rank = F.lit(0.0)
            for t in q.wanted:
                rank = rank + F.aggregate(F.transform(at(t), lambda _, j: 1 / ((j + 1).cast("double") * (j + 1))), F.lit(0.0), lambda s, x: s + x) * 0.1 / F.lit(1.64493406685)
            rank = rank / len(q.wanted)
        return found.select(self.key, "size", rank.alias("rank_score"))

    def search(self, question: str, k: int | None, only: Column | None = None, order: Sequence[Column] = ()) -> DataFrame:
        """The payload and rank of the ``k`` best texts among those where ``only`` holds; of all, in no order, where k is None."""
        payload = self._read("payload").drop("batch")
        hits = self.matches(question).join(payload if only is None else payload.where(only), self.key)
        return hits if k is None else hits.orderBy(F.desc("rank_score"), *order, self.key).limit(k)


def _all(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _any(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out
