"""Secret scans: fixed patterns, and lexing of assignments into name-literal pairs.

``scan`` finds spans of four kinds in a whole text:

- ``assign``, ``access``, ``hex``: fixed patterns, leftmost and non-overlapping for each kind.
- ``named``: the method's own. Source and configuration syntax (``name = "x"``, ``name: x``,
  ``"name": "x"``, ``name := x``, ``name => x``, ``a["name"] = x``, ``name: type = "x"``) is lexed into pairs;
  literals may have prefixes, triple quotes, and stand behind opening brackets or on the next line; literals that are
  joined (``"a" + "b"``) are one value of several spans. Calls with a name and a literal (``set("name", "x")``) and
  elements (``<name>x</name>``) are pairs too. A pair whose value is a name that the same text assigns passes on that name's literal (constants propagate through any chain; a cycle ends
  it). A literal is scored by the most sensitive name that it reaches, times how much it looks like a
  secret; those of ``LEAST`` or more are spans of the literal without its quotes.

Spans are code points, end exclusive, ordered by start, then kind as listed.

Defined cases: a null text is an empty one and has no spans; long texts are scanned whole; repeated rows
are scanned each for itself; an empty table gives an empty result; other columns are never read by
``find_secrets`` and are passed on untouched by ``redact_secrets``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of

Span = tuple[int, int, str]
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A maximal run of hex digits: the same matches as runs of any length of which short ones are dropped.
HEX = re.compile(r"[0-9a-f]{32,}")
HEX_BYTES = bytes(104 if x in b"0123456789abcdef" else 32 for x in range(256))
# A literal: a prefix such as f or b, then triple or single quotes. Possessive, so that a failed look-ahead ends it.
QUOTED = r"""(?:[rR][bBfF]|[bBfF][rR]|[rRbBuUfFL]|u8|[$@]{1,2})?(?:\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]|\\[^\n])*+"|'(?:[^'\\\n]|\\[^\n])*+')"""
# A type: a dotted name with at most three levels of brackets, alternatives joined by |.
_IN = r"\[(?:[^\[\]\n=]|\[(?:[^\[\]\n=]|\[[^\[\]\n=]*+\])*+\])*+\]|<(?:[^<>\n=]|<(?:[^<>\n=]|<[^<>\n=]*+>)*+>)*+>"
_ATOM = rf"&?(?:'[a-z]++[ \t]+)?(?:mut[ \t]+)?[A-Za-z_](?:[\w.]|::)*+(?:{_IN})?(?:\[\])*+\??"
TYPE = rf"{_ATOM}(?:[ \t]*\|[ \t]*{_ATOM})*+"
# A name starts where a run of name characters does and is taken whole, so that long runs take linear time. It may be a
# key in a subscript and have a type. A literal may stand behind opening brackets and line breaks, unless it is
# itself a key; an unquoted value may stand alone on the next line, indented, behind a colon.
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])[-.]*([A-Za-z_][A-Za-z0-9_.\-]*+)(?:["']?[ \t]*\]|["']|\[\d*\]|[ \t]+(?:\[\]byte|string)(?=[ \t]*=))?[ \t]*"""
    rf"""(?::[ \t]*+{TYPE}[ \t]*=(?![=>])(?=[ \t\r\n(\[{{\\]*+(?:{QUOTED}))|:=|=>|=(?!=)|:(?!:))[ \t]*"""
    rf"""(?:(?P<open>(?:[ \t\r\n(\[{{]|\\\r?\n)*+)(?P<quoted>{QUOTED})(?!\s*+(?::(?!:)|=>?))|(?P<next>(?:[|>][+\-]?)?[ \t]*\r?\n[ \t]+(?P<alone>[^\s"',;(){{}}\[\]<>:=]+)(?=[ \t]*\r?(?:\n|\Z)))|(?P<plain>[^\s"',;(){{}}\[\]<>]+))""",
    re.DOTALL,
)
MORE = re.compile(rf"[\s,]*+({QUOTED})(?!\s*+(?::(?!:)|=>?))", re.DOTALL)
# What joins a literal to the one before it: an operator, with a line break on either side of it, or nothing but blanks.
JOINED = re.compile(rf"[ \t]*+(?:(?:\+|\.\.?|&|\\)[ \t]*+(?:\r?\n[ \t]*+)?|\r?\n[ \t]*+(?:\+|\.\.?|&)[ \t]*+)?({QUOTED})(?!\s*+(?::(?!:)|=>?))", re.DOTALL)
CALL = re.compile(rf"\(\s*+({QUOTED})\s*+,\s*+({QUOTED})(?=\s*+[,)])", re.DOTALL)
ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*+)(?:\s[^<>]*+)?>([^<>\s]{8,}+)</\1\s*>")
FIELD = re.compile(r"\{[^{}]*\}")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How sensitive a part of a name is.
PARTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6, "bearer": 0.7, "key": 0.6, "access": 0.3, "api": 0.3, "signing": 0.4, "encryption": 0.4}
PLACEHOLDER = re.compile(r"^(?:\$\{?\w+\}?|%\w+%|<.*>|\{\{.*\}\}|(.)\1*|changeme|example|placeholder|your[_-].*|none|null|true|false|undefined)$", re.IGNORECASE)
LEAST = 0.5


def name_score(name: str) -> float:
    """The sum of a name's sensitive parts, 1 at most."""
    return min(1.0, sum(PARTS.get(p.lower(), 0.0) for p in PART.findall(name)))


def literal_score(value: str) -> float:
    """0 for short ones and placeholders, else from the entropy of its characters."""
    if len(value) < 8 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) or any(not c.isalnum() for c in value)
    return min(1.0, entropy / 3) * (1.0 if mixed else 0.7)


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if (":" in text or "=" in text) and any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in text.encode("utf-8", "surrogatepass").translate(HEX_BYTES):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def unquoted(text: str, start: int, end: int) -> tuple[str, int, int]:
    """(value, start, end) of a literal without prefix and quotes, triple ones also without outer white space.

    The value of a formatted literal is without its replacement fields."""
    at = start
    while text[at] not in "\"'":
        at += 1
    q = 3 if end - at >= 6 and text[at : at + 3] in ('"""', "'''") else 1
    formatted = "f" in text[start:at].lower()
    start, end = at + q, end - q
    if q == 3:
        while start < end and text[start].isspace():
            start += 1
        while start < end and text[end - 1].isspace():
            end -= 1
    value = text[start:end]
    return FIELD.sub("", value) if formatted else value, start, end


def joined(text: str, start: int, end: int) -> tuple[str, list[tuple[int, int]], int]:
    """(value, spans, end) of the literal at start and those joined to it."""
    value, *span = unquoted(text, start, end)
    parts, spans = [value], [tuple(span)]
    while more := JOINED.match(text, end):
        value, *span = unquoted(text, more.start(1), more.end(1))
        parts.append(value)
        spans.append(tuple(span))
        end = more.end()
    return "".join(parts), spans, end


Pair = tuple[str, str, list[tuple[int, int]], bool]


def pairs(text: str) -> list[Pair]:
    """(name, value, spans, quoted) of every assignment, in order; each literal of a bracketed list is one."""
    out: list[Pair] = []
    at = 0  # the end of the literals taken so far: what lies among them is no pair, and none is walked twice
    for m in PAIR.finditer(text):
        if m.start() < at:
            continue
        if m["quoted"] is None:
            g = "plain" if m["plain"] is not None else "alone"
            out.append((m[1], m[g], [m.span(g)], False))
            continue
        value, spans, at = joined(text, m.start("quoted"), m.end("quoted"))
        out.append((m[1], value, spans, True))
        if any(c in m["open"] for c in "([{"):
            while more := MORE.match(text, at):
                value, spans, at = joined(text, more.start(1), more.end(1))
                out.append((m[1], value, spans, True))
    at = 0
    for m in CALL.finditer(text):
        if m.start() < at:
            continue
        name = unquoted(text, *m.span(1))[0]
        if NAME.fullmatch(name):
            value, spans, at = joined(text, *m.span(2))
            out.append((name, value, spans, True))
    out += [(m[1], m[2], [m.span(2)], True) for m in ELEMENT.finditer(text)]
    return out


def named_spans(text: str) -> list[Span]:
    if "=" not in text and ":" not in text and "</" not in text and "('" not in text and '("' not in text:
        return []
    found = pairs(text)
    literal: dict[str, list[tuple[str, list[tuple[int, int]]]]] = {}
    alias: dict[str, set[str]] = {}
    names = {p[0] for p in found}
    for name, value, spans, quoted in found:
        if not quoted and value in names and value != name and NAME.fullmatch(value):
            alias.setdefault(value, set()).add(name)
        else:
            literal.setdefault(name, []).append((value, spans))
    out: set[Span] = set()
    for name, values in literal.items():
        reached, todo = {name}, [name]
        while todo:
            for x in alias.get(todo.pop(), ()):
                if x not in reached:
                    reached.add(x)
                    todo.append(x)
        weight = max(map(name_score, reached))
        if weight > 0:
            out |= {(a, b, "named") for value, spans in values if weight * literal_score(value) >= LEAST for a, b in spans if a < b}
    return sorted(out)


def scan(text: str) -> list[Span]:
    """All spans of a text."""
    return sorted(base_spans(text) + named_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    out, at, i = [], 0, 0
    spans = sorted((a, b) for a, b, _ in spans)
    while i < len(spans):
        a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] <= b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[at:a], mark]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<start, end, kind>> of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return documents_of(documents).mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def secret_digest(documents: DataFrame) -> DataFrame:
    """doc_id, counts by fixed kind, a digest of the fixed spans, and all spans as text."""
    found = find_secrets(documents)
    text = lambda only: F.array_join(F.transform(only, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "named")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.encode(text(base), "UTF-8"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact_secrets(documents: DataFrame, column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with secrets in ``column`` replaced; a null stays null."""
    at = documents.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [t and (redact(t, s, mark) if (s := scan(t)) else t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type))

    return documents.mapInArrow(run, documents.schema)
