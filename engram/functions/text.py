"""Text expressions: cleaning, noise and injection tests, chunks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .categories import CANONICAL, LOWER, NAMES

#: The patterns of an injection; (?U) takes white space as Python does.
INJECTION = (
    r"(?iU)ignore\s+(all\s+)?previous\s+(instructions?|prompts?|rules?)",
    r"(?iU)ignore\s+(the\s+)?(above|system|prior)\s+",
    r"(?iU)you\s+are\s+now\s+",
    r"(?iU)new\s+instructions?\s*:",
    r"(?iU)forget\s+(all\s+)?(your\s+)?(instructions?|rules?|constraints?)",
    r"(?iU)override\s+(system|safety|security)",
    r"(?iU)jailbreak",
    r"(?iU)do\s+anything\s+now",
    r"(?iU)act\s+as\s+(if\s+you\s+are\s+|a\s+)?(?!the\s+knowledge)",
    r"(?iU)pretend\s+(to\s+be|you\s+are)",
    r"(?iU)bypass\s+(your\s+)?(restrictions?|rules?|filters?)",
    r"(?iU)reveal\s+(your\s+)?(system\s+prompt|instructions?)",
    r"(?iU)what\s+(is|are)\s+your\s+(system\s+)?instructions?",
    r"(?iU)repeat\s+(the\s+)?(system\s+)?prompt",
    r"(?iU)print\s+(your\s+)?(system\s+)?prompt",
)
#: Entity names that say nothing, verbs that begin function names, and patterns of noise.
GENERIC_NAMES = (
    "main", "fix", "update", "test", "bug", "feature", "release", "merge", "commit", "branch", "tag", "none", "null", "true", "false", "yes", "no",
    "unknown", "default", "master", "develop", "head", "base", "origin", "main street", "project", "agent", "server", "client", "frontend", "backend",
    "api", "database", "file", "code", "script", "function", "model", "config", "configuration", "configuration files", "server logic", "cli scripts",
    "comment", "request_changes", "review", "pull request", "issue", "error", "warning", "info", "debug", "log", "output", "input", "data", "result",
    "response", "request", "query", "search", "session", "venv", "__pycache__", "self", "cls", "args", "kwargs", "module", "package", "class", "method",
    "variable", "parameter", "object", "instance", "constructor", "prototype", "callback", "promise", "async", "await", "import", "export", "return",
    "div", "span", "button", "form", "table", "body", "header", "footer", "container", "wrapper", "content", "sidebar", "modal", "dialog", "user",
    "system", "app",
)
VERBS = "get|set|on|handle|update|create|load|init|dispatch|enforce|dispose|is|has|should|can|will|fetch|render|toggle|parse|validate|process|compute|calculate|check|find|show|hide|enable|disable"
#: Those that name cases are case-sensitive.
NOISE = (
    r"^[0-9.,:/\s%-]+$", r"^(feature|fix|agent|bugfix|hotfix|release|develop)/", r"\(\)$", r"(?U)^--?\w", r"(?U)^[\w-]+\.[\w-]+$", r"(?U)^\w+\.(txt|log|tmp|bak|csv|json|xml|yaml|yml|ini|cfg|conf)$",
    r"(?U)^\d+\s*(ppi|dpi|px|pt|em|rem|%)$", r"^[0-9]+ ?x[0-9]+$", rf"^({VERBS})[A-Z][a-zA-Z0-9]*$", r"(?U)^(the |a |an )?\w+\s+(color|mode|size|type|name|value|data|list|set|map|view|state|style|config|option|button)s?$",
)


def is_noise(name: Column, allowed: Sequence[str] = ("Vue.js", "Node.js", "Next.js")) -> Column:
    """Entity names that say nothing: too short, generic, numbers, branches, calls, flags, selectors, files, phrases."""
    hit = (F.length(name) <= 2) | F.lower(name).isin(list(GENERIC_NAMES))
    for p in NOISE:
        hit = hit | (name.rlike(p) if "[A-Z]" in p else F.lower(name).rlike(p))
    return hit & ~name.isin(list(allowed))


def injection(text: Column) -> Column:
    hit = F.lit(False)
    for p in INJECTION:
        hit = hit | text.rlike(p)
    return hit


def sanitised(text: Column, most: int) -> Column:
    """Without control and zero-width characters, trimmed, cut."""
    return F.left(F.trim(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‏⁠﻿]", "")), F.lit(most))


def roles_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?im)^[ \t]*(system|user|assistant|human)[ \t]*:", "[$1]:")


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, code islands and tags gone, five entities decoded, white space single."""
    c = F.regexp_replace(html, r"(?s)<\?.*?\?>", " ")
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style\b.*?</style>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def embedding_input(prefix: Column, category: Column, tags: Column, content: Column) -> Column:
    """Prefix, category, tags and content, those that there are."""
    return F.concat_ws(". ", prefix, category, F.when(F.size(tags) > 0, F.array_join(tags, ", ")), content)


def chunk_end(text: str, at: int, most: int) -> int:
    """Where the chunk from ``at`` on ends: before the last paragraph mark, else the last line mark, else after the last
    full stop, else exclamation mark, else question mark, whichever first lies beyond a third of ``most``; else after ``most``."""
    limit = at + most
    if limit >= len(text):
        return len(text)
    for mark, kept in (("\n\n", 0), ("\n", 0), (". ", 2), ("! ", 2), ("? ", 2)):
        place = text.rfind(mark, at, limit)
        if place - at > most // 3:
            return place + kept
    return limit


def chunks_of(text: str | None, most: int = 6000, overlap: int = 500) -> list[tuple[str, int]]:
    """(chunk, offset) of the trimmed text: each chunk starts ``overlap`` characters before the end of the one before, or at
    its end where that would not move on. A last chunk longer than the overlap is so followed by its own final part."""
    text = (text or "").strip()
    if len(text) <= most:
        return [(text, 0)] if text else []
    out, at = [], 0
    while at < len(text):
        end = chunk_end(text, at, most)
        if piece := text[at:end].strip():
            out.append((piece, at))
        at = end - overlap if end - overlap > at else end
    return out


def chunked(documents: DataFrame, most: int = 6000, overlap: int = 500, keep: Sequence[str] = ()) -> DataFrame:
    """id, chunk_index, chunk_total, chunk_offset, chunk of every document with text, and its columns of ``keep``."""
    names = ["id", "chunk_index", "chunk_total", "chunk_offset", "chunk", *keep]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            found = [(i, k, len(c), o, t, *more) for i, text, *more in rows.itertuples(index=False) for c in [chunks_of(text, most, overlap)] for k, (t, o) in enumerate(c)]
            yield pd.DataFrame(found, columns=names)

    kinds = dict(documents.dtypes)
    more = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return documents.select("id", "content", *keep).mapInPandas(run, "id long, chunk_index long, chunk_total long, chunk_offset long, chunk string" + more)


def composed(text: Column) -> Column:
    """Unicode composition (NFC)."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return run(text)


def name_of(json: Column) -> Column:
    """A name in JSON of several shapes: a text, an object with name, or one with topic.name or node.name; null for others."""
    v = F.try_parse_json(json)
    return F.coalesce(*[F.try_variant_get(v, path, "string") for path in ("$.name", "$.topic.name", "$.node.name")], F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def with_prefix(prefix: Column, category: Column, tags: Column, content: Column) -> Column:
    """A chunk's embedding text behind what a model says of its place; prefixes of five characters or fewer are none."""
    said = F.trim(prefix)
    return embedding_input(F.when(F.length(said) > 5, said), category, tags, content)


def category_of(value: Column) -> Column:
    """Exact known name, then canonical or known name in lower case, then the first canonical name that the value holds, else as it is, lower-cased."""
    low = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    known = lambda names, x: F.element_at(F.create_map(*[F.lit(y) for kv in names.items() for y in kv]), x)
    held = [F.when(low.contains(c), F.lit(c)) for c in CANONICAL]
    return F.coalesce(known(NAMES, value), F.when(low.isin(list(CANONICAL)), low), known(LOWER, low), *held, low)
