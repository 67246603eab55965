"""What a crawl may fetch and where it begins: nested sitemaps by rounds, robots rules by longest match.

``sitemap_pages`` follows sitemap indexes from the roots on: each round joins the addresses that are new with the fetched files, reads the
children of indexes and the pages of plain maps, and goes on with addresses that no round has seen, so that cycles end. Files may be
gzipped. ``robots_rules`` and ``allowed`` keep to the rules of RFC 9309: groups of agents, the longest matching pattern, allow on ties.

Defined cases: a missing, broken or empty file has no locations, and broken ones are told by ``sitemap_errors``; an address that
several files name counts once, at its least round; relative and blank locations are left out; hosts without rules allow everything.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

LOCATION = re.compile(r"<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)", re.IGNORECASE)
FILES = "url string, kind string, at long, location string, error string"


def locations(files: DataFrame) -> DataFrame:
    """(url, kind, at, location, error) of sitemap files (url, body binary): kind is index or pages; one row with an error for a broken file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out: list[tuple] = []
            for url, body in zip(rows["url"], rows["body"]):
                try:
                    data = bytes(body or b"")
                    text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8", "replace")
                except (OSError, EOFError, ValueError) as e:
                    out.append((url, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                kind = "index" if re.search(r"<(\w+:)?sitemapindex\b", text, re.IGNORECASE) else "pages"
                found = [html.replace("&amp;", "&") for html in LOCATION.findall(text)]
                out += [(url, kind, i, x, None) for i, x in enumerate(found) if re.match(r"https?://", x, re.IGNORECASE)]
            yield pd.DataFrame(out, columns=["url", "kind", "at", "location", "error"])

    return files.select("url", "body").mapInPandas(run, FILES)


def sitemap_errors(files: DataFrame) -> DataFrame:
    return locations(files).where("error is not null").select("url", "error")


def sitemap_pages(files: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """(url, sitemap, round) of every page that the maps below ``roots`` (url) name: its first map, by round and address. ``rounds`` bounds the depth, where given."""
    read = cut(locations(files).where("error is null"), "sitemaps")
    frontier = cut(roots.select("url").where("url is not null").distinct(), "sitemap-round")
    seen, pages, n = frontier, None, 0
    while frontier.take(1) and (rounds is None or n < rounds):
        here = cut(read.join(frontier, "url", "left_semi"), "sitemap-round")
        found = here.where("kind = 'pages'").select(F.col("location").alias("page"), F.col("url").alias("sitemap"), F.lit(n).alias("round"))
        pages = found if pages is None else pages.unionByName(found)
        frontier = cut(here.where("kind = 'index'").select(F.col("location").alias("url")).distinct().join(seen, "url", "left_anti"), "sitemap-round")
        seen, n = seen.unionByName(frontier), n + 1
    if pages is None:
        return roots.limit(0).select("url", F.lit("").alias("sitemap"), F.lit(0).alias("round"))
    first = pages.groupBy(F.col("page").alias("url")).agg(F.min(F.struct("round", "sitemap")).alias("first"))
    return first.select("url", "first.sitemap", "first.round")


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(host, allow, pattern, sitemap) of robots files (host, text): the rules of the group that names ``agent``, else of the one for all; and the sitemaps that a file names."""

    def rules(text: str) -> list[tuple]:
        groups: dict[str, list[tuple[bool, str]]] = {}
        maps, names, open_ = [], [], False
        for line in text.splitlines():
            field, _, value = line.split("#", 1)[0].partition(":")
            field, value = field.strip().lower(), value.strip()
            if field == "sitemap" and value:
                maps.append(value)
            elif field == "user-agent":
                names = names if open_ else []
                names.append(value.lower())
                open_ = True
                groups.setdefault(value.lower(), [])
            elif field in ("allow", "disallow"):
                open_ = False
                for name in names:
                    if value:
                        groups[name].append((field == "allow", value))
        mine = groups.get(agent.lower(), groups.get("*", []))
        return [(a, p, None) for a, p in mine] + [(None, None, m) for m in maps]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield pd.DataFrame([(h, *r) for h, t in zip(rows["host"], rows["text"]) for r in rules(t or "")], columns=["host", "allow", "pattern", "sitemap"])

    return files.select("host", "text").mapInPandas(run, "host string, allow boolean, pattern string, sitemap string")


def path_of(url: Column) -> Column:
    """Path and query, / for none."""
    rest = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    return F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (url and others) with allowed: whether the longest pattern that matches its path, of its host's, allows it; allow on ties, and without a match."""
    # A pattern begins at the path's start; * is any text, a last $ the end. Everything else is literal.
    literal = F.regexp_replace("pattern", r"([\\.+?()\[\]{}|^$])", r"\\$1")
    ending = F.regexp_replace(literal, r"\\\$$", r"\$")
    regex = F.concat(F.lit("^"), F.regexp_replace(ending, r"\*", ".*"))
    host_rules = cut(rules.where("pattern is not null").select(F.col("host").alias("__host"), "allow", regex.alias("__regex"), F.length("pattern").alias("__length")).distinct(), "robots")
    keyed = urls.withColumn("__host", F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))).withColumn("__path", path_of(F.col("url")))
    # Addresses that repeat are judged once; rules are few a host, addresses many, so the join is splittable by address.
    distinct = keyed.select("url", "__host", "__path").distinct()
    hit = distinct.join(host_rules, "__host").where(F.expr("__path rlike __regex"))
    said = hit.groupBy("url").agg(F.max(F.struct("__length", "allow")).alias("best")).select("url", F.col("best.allow").alias("allowed"))
    return urls.join(said, "url", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
