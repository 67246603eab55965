"""Documents of a folder as rows: plain text, DOCX, PDF text layers; images and scans to a reader of their own.

Spark's ``binaryFile`` source lists and reads the files, from any store that Spark reads, as a batch or as a stream that takes each new file
once (``stream=True``); parsing runs where the files are read. A broken file is a row with an error, never a failure.

Rows: path, kind (text, docx, pdf, image, other), content, error, needs_vision (an image, or a PDF without text, which ``vision``, a provider
of (kind, bytes) to text, reads where given). PDF text: all objects of the file are found by their marks, object streams included; pages are
taken in the order of the page tree; FlateDecode and uncompressed streams; text operators, with a font's ToUnicode map where it has one. Encrypted files and other
filters are told as errors.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .importers import docx_text

KINDS = {"text": ("txt", "md", "markdown", "rst", "org", "csv", "tsv", "log"), "docx": ("docx",), "pdf": ("pdf",), "image": ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif")}
KIND_OF = {e: kind for kind, ends in KINDS.items() for e in ends}
SCHEMA = "path string, kind string, content string, error string, needs_vision boolean"

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.DOTALL)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}


def stream_of(body: bytes) -> bytes:
    head, found = body.split(b"stream", 1)[0], STREAM.search(body)
    if not found:
        return b""
    filters = re.findall(rb"/(\w+Decode)\b", head)
    if any(f != b"FlateDecode" for f in filters):
        raise ValueError(f"filter {b', '.join(filters).decode()}")
    data = found[1]
    return zlib.decompressobj().decompress(data) if filters else data


def objects_of(data: bytes) -> dict[int, bytes]:
    """Every object's bytes by number; later ones replace earlier ones, as after an update."""
    found = {int(n): body for n, body in OBJECT.findall(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body.split(b"stream", 1)[0]:
            inner = stream_of(body)
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            marks = [int(x) for x in inner[:first].split()]
            ends = [*marks[3::2], len(inner) - first]
            for n, at, end in zip(marks[::2], marks[1::2], ends):
                found.setdefault(n, inner[first + at : first + end])
    return found


def references(body: bytes, name: bytes) -> list[int]:
    """Objects that a key refers to: one, or a list."""
    m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def unicode_map(cmap: bytes) -> dict[bytes, str]:
    """Codes to text of a ToUnicode map: single entries, and ranges of at most 65,536 codes."""
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            base = int(c, 16)
            for i in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                out[(int(a, 16) + i).to_bytes(len(a) // 2, "big")] = text(b"%0*x" % (len(c), base + i))
    return out


def string_of(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", one, token[1:-1], flags=re.DOTALL)


def page_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """The text that a page's operators show: a new line where the place moves down, a blank for wide gaps."""
    out: list[str] = []
    stack: list[bytes] = []
    codes: dict[bytes, str] = {}

    def shown(token: bytes) -> str:
        data = string_of(token)
        if not codes:
            return data.decode("cp1252", "replace")
        n = len(next(iter(codes)))
        return "".join(codes.get(data[i : i + n], "") for i in range(0, len(data), n))

    for m in TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/" or t[:1] in b"-+.0123456789":
            stack.append(t)
            continue
        if t == b"Tf":
            codes = next((fonts.get(x[1:], {}) for x in reversed(stack) if x[:1] == b"/"), {})
        elif t in (b"Tj", b"'", b'"') and stack:
            out.append(("\n" if t != b"Tj" else "") + (shown(stack[-1]) if stack[-1][:1] in b"(<" else ""))
        elif t == b"TJ":
            start = len(stack) - 1 - stack[::-1].index(b"[") if b"[" in stack else 0
            for x in stack[start:]:
                if x[:1] in b"(<":
                    out.append(shown(x))
                elif x[:1] in b"-0123456789." and float(x) < -200:
                    out.append(" ")
        elif t in (b"Td", b"TD") and len(stack) > 1:
            out.append("\n" if float(stack[-1]) else " ")
        elif t in (b"T*", b"ET", b"Tm"):
            out.append("\n")
        stack.clear()
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def pdf_text(data: bytes) -> str:
    """The text layer, pages apart by blank lines; empty for scans."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF")
    if b"/Encrypt" in data:
        raise ValueError("encrypted")
    objects = objects_of(data)
    page = lambda n: re.search(rb"/Type\s*/Page\b(?!s)", objects.get(n, b""))
    order: list[int] = []
    todo = [n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)]
    todo = [k for n in todo[-1:] for k in references(objects[n], b"Pages")]
    seen: set[int] = set()
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        if page(n):
            order.append(n)
        else:
            todo += reversed(references(objects.get(n, b""), b"Kids"))
    parts = []
    for n in order or [n for n in sorted(objects) if page(n)]:
        body = objects[n]
        named = re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", body + b"".join(objects.get(r, b"") for r in references(body, b"Resources") + references(body, b"Parent")))
        fonts = {name: unicode_map(stream_of(objects[u[0]])) for name, ref in named if (font := objects.get(int(ref), b"")) and (u := references(font, b"ToUnicode")) and u[0] in objects}
        if text := page_text(b"\n".join(stream_of(objects[c]) for c in references(body, b"Contents") if c in objects), fonts):
            parts.append(text)
    return "\n\n".join(parts)


def extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""


def documents(spark: SparkSession, path: str, least: int = 30, vision: Callable[[str, bytes], str] | None = None, stream: bool = False) -> DataFrame:
    """All documents below ``path``, but for locks and texts of under ``least`` characters; files of other kinds are left out."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(path)
    ends = [*KIND_OF]
    files = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(ends) & ~F.col("path").rlike(r"/(~|\.)[^/]*$")).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for name, data in zip(rows["path"], rows["content"]):
                kind, data, text, error, scan = KIND_OF[extension(name)], bytes(data), "", None, False
                try:
                    if kind == "text":
                        text = data.decode("utf-8", "replace")
                    elif kind == "docx":
                        text = docx_text(data)
                    elif kind == "pdf":
                        text = pdf_text(data)
                    scan = kind in ("pdf", "image") and len(text.strip()) < least
                    if scan and vision:
                        text = vision(kind, data) or ""
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, zlib.error, TypeError, IndexError) as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((name, kind, text.replace("\x00", ""), error, scan))
            yield pd.DataFrame(out, columns=["path", "kind", "content", "error", "needs_vision"])

    found = files.mapInPandas(run, SCHEMA)
    return found.where(F.col("error").isNotNull() | F.col("needs_vision") | (F.length(F.trim("content")) >= least))
