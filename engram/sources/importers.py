"""Exports, notes, pages and code as memories: (content, summary, source_type, source_ref, tags, confidence, created).

Readers are Spark's; parsing is native but where a format has no native parser (DOCX, Python source)."""

from __future__ import annotations

import ast
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_text

CHATGPT = "array<struct<title:string,create_time:double,conversation_id:string,id:string,mapping:map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double,metadata:struct<model_slug:string>>>>>>"
CLAUDE_WEB = "array<struct<uuid:string,name:string,summary:string,created_at:string,chat_messages:array<struct<sender:string,text:string,content:string>>>>"


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, text of every file; one row a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def chatgpt_conversations(exports: DataFrame) -> DataFrame:
    """From texts of exports: conversations of two messages or more, in order of time."""
    c = exports.select(F.explode(F.from_json("text", CHATGPT)).alias("c")).select("c.*")
    texts = F.filter(F.map_values("mapping"), lambda n: n["message"].isNotNull() & (F.trim(F.array_join(n["message"]["content"]["parts"], "\n")) != ""))
    ordered = F.array_sort(F.transform(texts, lambda n: F.struct(F.coalesce(n["message"]["create_time"], F.lit(0.0)).alias("t"), n["message"]["author"]["role"].alias("role"), F.array_join(n["message"]["content"]["parts"], "\n").alias("text"))))
    model = F.array_max(F.transform(F.map_values("mapping"), lambda n: n["message"]["metadata"]["model_slug"]))
    out = c.select(F.coalesce("conversation_id", "id").alias("conversation_id"), F.coalesce("title", F.lit("Untitled")).alias("title"), F.timestamp_seconds("create_time").alias("created"), model.alias("model"), ordered.alias("messages"))
    return out.where(F.size("messages") >= 2)


def claude_web_conversations(exports: DataFrame) -> DataFrame:
    """From texts of exports: a message's text, or the text parts of its content; human is user."""
    c = exports.select(F.explode(F.from_json("text", CLAUDE_WEB)).alias("c")).select("c.*")
    parts = lambda m: F.array_join(F.transform(F.filter(F.from_json(m["content"], "array<struct<type:string,text:string>>"), lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    body = lambda m: F.when(F.trim(m["text"]) != "", m["text"]).otherwise(F.coalesce(parts(m), m["content"], F.lit("")))
    messages = F.filter(F.transform("chat_messages", lambda m: F.struct(F.when(m["sender"] == "human", "user").otherwise("assistant").alias("role"), body(m).alias("text"))), lambda m: F.trim(m["text"]) != "")
    return c.select(F.col("uuid").alias("conversation_id"), F.coalesce("name", F.lit("Untitled")).alias("title"), F.to_timestamp("created_at").alias("created"), messages.alias("messages")).where(F.size("messages") >= 2)


def claude_memories(exports: DataFrame, least: int = 20) -> DataFrame:
    m = exports.select(F.explode(F.from_json("text", "array<struct<conversations_memory:string>>")).alias("m")).select(F.trim("m.conversations_memory").alias("content"))
    return m.where(F.length("content") >= least).select("content", F.lit("claude").alias("source_type"), F.lit(0.8).alias("confidence"))


def claude_projects(exports: DataFrame, least: int = 20) -> DataFrame:
    p = exports.select(F.explode(F.from_json("text", "array<struct<uuid:string,name:string,description:string,prompt_template:string>>")).alias("p")).select("p.*")
    line = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(label), c))
    text = F.concat_ws("\n", line("Project: ", F.col("name")), line("Description: ", F.col("description")), line("Prompt template: ", F.col("prompt_template")))
    return p.select(F.col("uuid").alias("source_ref"), text.alias("content"), F.lit(0.7).alias("confidence")).where(F.length("content") >= least)


def instruction_files(files: DataFrame, least: int = 10) -> DataFrame:
    """Instruction and memory files of assistant folders; the project is the folder below projects/."""
    mine = files.where(F.col("path").rlike(r"(^|/)CLAUDE\.md$|(^|/)memory/[^/]+\.md$") & (F.length(F.trim("text")) >= least))
    return mine.select(F.trim("text").alias("content"), F.col("path").alias("source_ref"), F.nullif(F.regexp_extract("path", r"projects/([^/]+)/", 1), F.lit("")).alias("project"), F.when(F.col("path").endswith("CLAUDE.md"), 0.9).otherwise(0.8).alias("confidence"))


def markdown_notes(files: DataFrame, least: int = 10) -> DataFrame:
    """Notes with front matter of simple key: value lines; without it the whole text is the body."""
    head = F.regexp_extract("text", r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    body = F.trim(F.regexp_replace("text", r"(?s)\A---\s*\n.*?\n---\s*\n", ""))
    key = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    category = F.when(F.lower(key("category")) == "uncategorized", None).otherwise(key("category"))
    return files.select(F.coalesce(key("title"), F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("title"), body.alias("content"), category.alias("category"), key("created").alias("created"), F.coalesce(key("pinned") == "true", F.lit(False)).alias("pinned"), F.coalesce(key("archived") == "true", F.lit(False)).alias("archived"), key("memo_id").alias("source_ref")).where(F.length("content") >= least)


def sticky_notes(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    tags = F.filter(F.concat(F.array(F.lower(F.trim("Note Color"))), F.transform(F.split(F.coalesce("Categories", F.lit("")), ","), lambda t: F.lower(F.trim(t)))), lambda t: t.isNotNull() & (t != ""))
    return rows.select(F.trim("Note Body").alias("content"), tags.alias("tags"), F.col("Priority").alias("priority")).where(F.length("content") >= least)


def website_pages(files: DataFrame, least: int = 50) -> DataFrame:
    """Pages as text: title from the page variable, else the first heading, else the file's name."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z]+)?$", 1), "_", " ")
    title = F.coalesce(*[F.nullif(F.trim(html_text(F.regexp_extract("text", p, 1))), F.lit("")) for p in (r"\$pageTitle\s*=\s*[\"']([^\"']+)[\"']", r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<h2[^>]*>(.*?)</h2>", r"(?is)<h3[^>]*>(.*?)</h3>")], name)
    section = F.nullif(F.regexp_extract("path", r"([^/]+?)__[^/]+$", 1), F.lit(""))
    return files.select("path", title.alias("title"), section.alias("section"), html_text(F.col("text")).alias("content")).where(F.length("content") >= least)


def docx_text(data: bytes) -> str:
    """Non-blank paragraphs with blank lines between."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter(f"{space}t")).strip() for p in root.iter(f"{space}p"))
    return "\n\n".join(p for p in found if p)


def docx_files(files: DataFrame, least: int = 20) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            texts = []
            for data in rows["content"]:
                try:
                    texts.append(docx_text(bytes(data)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append(None)  # not a document: no text
            yield pd.DataFrame({"path": rows["path"], "content": texts})

    found = files.where(~F.col("path").rlike(r"/~[^/]*$")).mapInPandas(run, "path string, content string")
    return found.where(F.length("content") >= least).withColumn("confidence", F.lit(0.5))


def commits(pages: DataFrame) -> DataFrame:
    """One memory a commit from (branch, text) pages of JSON, whatever branches it is on."""
    c = pages.select("branch", F.explode(F.from_json("text", "array<struct<sha:string,commit:struct<message:string,author:struct<name:string,date:string>>>>")).alias("c"))
    return c.groupBy("c.sha").agg(F.any_value("c.commit.message").alias("message"), F.any_value("c.commit.author.name").alias("author"), F.any_value("c.commit.author.date").alias("date"), F.array_sort(F.collect_set("branch")).alias("branches"))


def issues(pages: DataFrame) -> DataFrame:
    i = pages.select(F.explode(F.from_json("text", "array<struct<number:int,title:string,body:string,state:string,comments:int,pull_request:string>>")).alias("i")).select("i.*")
    return i.select("number", F.when(F.col("pull_request").isNull(), "issue").otherwise("pull_request").alias("kind"), "state", F.concat_ws("\n\n", "title", "body").alias("content"))


PRIORITY = ("main.", "app.", "index.", "server.", "cli.", "config", "schema", "model", "api", "core", "routes", "service")
SKIPPED = ("node_modules", ".git", "dist", "build", "vendor", "__pycache__", ".venv", "target")
EXTENSIONS = ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "rb", "php", "c", "cpp", "h", "cs", "sh", "sql", "vue")


def source_score(path: Column) -> Column:
    """+10 for each likely name, -2 for each folder down, -15 for tests, -20 for package markers."""
    low = F.lower(path)
    score = F.lit(0)
    for p in PRIORITY:
        score = score + F.when(low.contains(p), 10).otherwise(0)
    return score - 2 * (F.size(F.split(path, "/")) - 1) - F.when(low.contains("test"), 15).otherwise(0) - F.when(low.endswith("__init__.py"), 20).otherwise(0)


def top_sources(tree: DataFrame, k: int = 40, most_bytes: int = 100_000) -> DataFrame:
    """By repository: the k best source files of a (repo, path, size) tree."""
    skip = F.lit(False)
    for d in SKIPPED:
        skip = skip | F.array_contains(F.split("path", "/"), d)
    fit = tree.where(~skip & F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(list(EXTENSIONS)) & (F.col("size") <= most_bytes))
    w = Window.partitionBy("repo").orderBy(F.desc("score"), "path")
    return fit.withColumn("score", source_score(F.col("path"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def symbols_of(source: str) -> list[tuple[str, str, str, str, int, int]]:
    """(kind, name, signature, docstring, first line, last line) of a module's functions, classes and methods."""
    out = []

    def visit(node: ast.AST, owner: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                returns = f" -> {ast.unparse(x.returns)}" if x.returns else ""
                word = "async def" if isinstance(x, ast.AsyncFunctionDef) else "def"
                out.append(("method" if owner else "function", f"{owner}{x.name}", f"{word} {x.name}({ast.unparse(x.args)}){returns}", (ast.get_docstring(x) or "")[:500], x.lineno, x.end_lineno or x.lineno))
            elif isinstance(x, ast.ClassDef):
                bases = ", ".join(map(ast.unparse, x.bases))
                out.append(("class", f"{owner}{x.name}", f"class {x.name}({bases})" if bases else f"class {x.name}", (ast.get_docstring(x) or "")[:500], x.lineno, x.end_lineno or x.lineno))
                visit(x, f"{owner}{x.name}.")

    try:
        visit(ast.parse(source), "")
    except (SyntaxError, ValueError):
        return []  # not Python: no symbols
    return out


def code_symbols(files: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            found = [(p, *s) for p, t in zip(rows["path"], rows["text"]) for s in symbols_of(t or "")]
            yield pd.DataFrame(found, columns=["path", "kind", "name", "signature", "docstring", "first_line", "last_line"])

    return files.select("path", "text").mapInPandas(run, "path string, kind string, name string, signature string, docstring string, first_line int, last_line int")


def sitemap_urls(files: DataFrame, most: int) -> DataFrame:
    """The first distinct locations of sitemaps, in order."""
    urls = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("at", "url"))
    first = urls.groupBy("url").agg(F.min(F.struct("path", "at")).alias("first"))
    return first.orderBy("first", "url").limit(most).select("url")


def raw_conversations(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Conversations not stored yet by (source_type, title, message_count); a null title never equals."""
    keys = ["source_type", "title", "message_count"]
    return new.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")
