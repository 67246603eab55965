"""Models behind a batch interface, and the selections and effects around them.

A provider maps a batch of prompts to JSON texts (or vectors). Offline ones are deterministic, so that
everything around a model can be tested; a networked one is a callable of the same form."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Complete = Callable[[Sequence[str]], Sequence[str]]
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashing_embedder(size: int = 64) -> Embed:
    """Signed word hashes, normalised."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(size)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def first_sentence(prompts: Sequence[str]) -> list[str]:
    """An offline summariser: the first sentence, 120 characters at most."""
    return [json.dumps({"summary": re.split(r"(?<=[.!?])\s", p.strip(), maxsplit=1)[0][:120]}) for p in prompts]


def retried(call: Complete, tries: int = 5, wait: Callable[[float], None] = time.sleep) -> Complete:
    """The same provider, tried again after 1, 2, 4 ... seconds on failures that may pass, or empty or malformed JSON."""

    def run(prompts: Sequence[str]) -> Sequence[str]:
        for i in range(tries):
            try:
                out = call(prompts)
                for x in out:
                    json.loads(x)
                return out
            except (ConnectionError, TimeoutError, json.JSONDecodeError):
                if i + 1 == tries:
                    raise
                wait(2.0**i)
        raise AssertionError

    return run


def embedded(df: DataFrame, text: str, embed: Embed, batch: int = 32, name: str = "embedding") -> DataFrame:
    """A vector for each row's text, in batches; null for a null text."""
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", `{name}` array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            texts, out = rows[text].tolist(), []
            for i in range(0, len(texts), batch):
                out += list(embed([t or "" for t in texts[i : i + batch]]))
            yield rows.assign(**{name: [None if t is None else v for t, v in zip(texts, out)]})

    return df.mapInPandas(run, schema)


def completed(df: DataFrame, prompt: str, complete: Complete, schema: str, name: str = "answer", batch: int = 16) -> DataFrame:
    """A parsed answer for each row's prompt; null where it does not parse."""
    whole = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", `{name}` string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            prompts, out = rows[prompt].tolist(), []
            for i in range(0, len(prompts), batch):
                out += list(complete([p or "" for p in prompts[i : i + batch]]))
            yield rows.assign(**{name: out})

    return df.mapInPandas(run, whole).withColumn(name, F.from_json(name, schema))


def summarised(unsummarised: DataFrame, complete: Complete) -> DataFrame:
    """id, summary of rows without one."""
    return completed(unsummarised.select("id", F.left("content", F.lit(6000)).alias("p")), "p", complete, "summary string").select("id", F.col("answer.summary").alias("summary"))


DECISIONS = ("ADD", "UPDATE", "SUPERSEDE", "NOOP")


def write_decision(candidates: DataFrame, same: float = 0.98, near: float = 0.92) -> DataFrame:
    """Rule-based write decisions from (new_id, old_id, similarity): NOOP for the same, UPDATE for near, else ADD."""
    best = candidates.groupBy("new_id").agg(F.max_by(F.struct("old_id", "similarity"), F.struct("similarity", -F.col("old_id"))).alias("b"))
    return best.select("new_id", F.when(F.col("b.similarity") >= same, "NOOP").when(F.col("b.similarity") >= near, "UPDATE").otherwise("ADD").alias("action"), F.col("b.old_id").alias("target_id"))


def write_candidates(pairs: DataFrame, least: float = 0.85, most: int = 5) -> DataFrame:
    """(new_id, old_id, similarity, place) of each new row's ``most`` most similar stored ones of ``least`` or more."""
    order = Window.partitionBy("new_id").orderBy(F.desc("similarity"), "old_id")
    return pairs.where(F.col("similarity") >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def decided(new: DataFrame, candidates: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, action, target_id, content) of every new row (id, content).

    Without candidates a row is added, unasked. The judge sees the others with their candidates, best first, and adds ``answer`` (action, target_id,
    content), null where it failed: then the row is added too. Actions are read in any case of letters; unknown ones add. A target that is no candidate gives way to the
    most similar one, and an update or replacement without content takes the new row's own."""
    seen = candidates.groupBy(F.col("new_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "old_id", "similarity"))).alias("candidates"))  # five a row
    asked = judge(new.select("id", "content").join(seen, "id"))
    said = new.select("id", "content").join(asked.select("id", "candidates", "answer"), "id", "left")
    action = F.upper(F.coalesce("answer.action", F.lit("ADD")))
    action = F.when(action.isin(*DECISIONS), action).otherwise("ADD")
    changes = action.isin("UPDATE", "SUPERSEDE")
    ids = F.transform("candidates", lambda c: c["old_id"])
    target = F.when(F.array_contains(ids, F.col("answer.target_id")), F.col("answer.target_id")).otherwise(F.element_at(ids, 1))
    content = F.when(F.length(F.trim(F.coalesce("answer.content", F.lit("")))) > 0, F.col("answer.content")).otherwise(F.col("content"))
    return said.select("id", action.alias("action"), F.when(changes, target).alias("target_id"), F.when(changes, content).otherwise(F.col("content")).alias("content"))


def written_back(stored: DataFrame, new: DataFrame, decisions: DataFrame, embed: Embed | None = None) -> dict[str, DataFrame]:
    """The write path's tables: ``inserted`` (ADD and SUPERSEDE, the latter with supersedes), ``stored`` after updates and archivings, ``skipped``.

    An update takes the decision's content, with a new vector where there is an ``embed``, and the new row's tags and category where it has some;
    of several new rows that name one target the last, by identifier, counts. A superseded row is archived, its reason in its metadata."""
    j = new.join(decisions.select("id", "action", "target_id", F.col("content").alias("decided")), "id")
    inserted = j.where("action in ('ADD', 'SUPERSEDE')").select(*new.columns, F.when(F.col("action") == "SUPERSEDE", F.col("target_id")).alias("supersedes"))
    last = j.where("action in ('UPDATE', 'SUPERSEDE')").groupBy("target_id", "action").agg(F.max_by(F.struct("decided", "tags", "category"), "id").alias("u"))
    updates = last.where("action = 'UPDATE'").select(F.col("target_id").alias("id"), F.col("u.decided").alias("__content"), F.col("u.tags").alias("__tags"), F.col("u.category").alias("__category"))
    gone = last.where("action = 'SUPERSEDE'").select(F.col("target_id").alias("id"), F.lit(True).alias("__gone"))
    both = stored.join(updates, "id", "left").join(gone, "id", "left")
    changed = both.withColumns({
        "content": F.coalesce("__content", "content"), "tags": F.coalesce("__tags", "tags"),
        "category": F.when(F.col("__gone"), F.lit("_archived")).otherwise(F.coalesce("__category", "category")),
        "archived_reason": F.when(F.col("__gone"), F.lit("superseded")),
    })
    if embed is not None:
        fresh = embedded(changed.where("__content is not null").select("id", "content"), "content", embed, name="__vector").select("id", "__vector")
        changed = changed.join(fresh, "id", "left").withColumn("embedding", F.coalesce("__vector", F.col("embedding").cast("array<double>"))).drop("__vector")
    return {"inserted": inserted, "stored": changed.drop("__content", "__tags", "__category", "__gone"), "skipped": j.where("action = 'NOOP'").select("id")}


def applied(new: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """The rows of each branch of the write path; rows without a decision are added."""
    j = new.join(decisions, new["id"] == decisions["new_id"], "left").withColumn("action", F.when(F.col("action").isin(*DECISIONS), F.col("action")).otherwise("ADD"))
    return {a: j.where(F.col("action") == a) for a in DECISIONS}


def reranked(rows: DataFrame, score: Callable[[Sequence[str]], Sequence[float]] | None, k: int) -> DataFrame:
    """Rows ordered by a scorer over summary and content, or as they are without one; k of them."""
    if score is None:
        return rows.limit(k)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(rerank=list(score([f"{s or ''}\n\n{(c or '')[:1000]}" for s, c in zip(p["summary"], p["content"])])))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", rerank double"
    return rows.mapInPandas(run, schema).orderBy(F.desc("rerank"), "id").limit(k)


def query_variants(original: str, variants: Sequence[str], most: int) -> list[str]:
    """Variants without case-insensitive repeats or the original, in order."""
    seen, out = {original.strip().lower()}, []
    for v in variants:
        if (low := v.strip().lower()) and low not in seen:
            seen.add(low)
            out.append(v.strip())
    return out[:most]


def search_questions(original: str, expand: Callable[[str], Sequence[str]] | None = None, decompose: Callable[[str], Sequence[str]] | None = None, hypothesise: Callable[[str], str] | None = None) -> list[tuple[str, str]]:
    """(text to embed, text to search) of every search that a question makes: itself, at most three variants, at most four parts, each once.

    A hypothetical answer of more than 20 characters takes the question's place in the vector of the first. A provider that fails adds nothing."""

    def said(provide, empty):
        try:
            return (provide(original) if provide else None) or empty
        except Exception:  # a model that fails: the search goes on without it
            return empty

    answer = said(hypothesise, "").strip()
    variants = query_variants(original, said(expand, []), 3)
    known = {v.lower() for v in variants}
    parts = [p for p in query_variants(original, said(decompose, []), 1 << 30) if p.lower() not in known][:4]
    return [(answer if len(answer) > 20 else original, original), *((x, x) for x in [*variants, *parts])]
