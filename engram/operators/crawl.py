"""Fetching behind a provider, rounds of a crawl, and what a crawl stores.

A fetch provider maps (url) to (url, title, text, links array<string>); a page that could not be had is absent.
``page_fetcher`` is the offline one, over a table of raw pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import html_text, html_title
from .writes import signals_recorded

Fetch = Callable[[DataFrame], DataFrame]
HOST = r"^https?://([^/:?#]+)"


def read_pages(pages: DataFrame) -> DataFrame:
    """Every row of pages (url, html), with title, plain text, the distinct references as they stand (hrefs), and links: those with those to a path made absolute."""
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    hrefs = F.array_distinct(F.expr("regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)"))
    links = F.array_distinct(F.transform("hrefs", lambda h: F.when(h.startswith("/"), F.concat(base, h)).otherwise(h)))
    return pages.withColumn("hrefs", hrefs).withColumns({"title": html_title(F.col("html")), "text": html_text(F.col("html")), "links": links})


def page_fetcher(pages: DataFrame) -> Fetch:
    """Pages (url, html) as if fetched: title, plain text, and links with those to a path made absolute; one page of a url."""

    def fetch(urls: DataFrame) -> DataFrame:
        found = urls.select("url").distinct().join(pages.select("url", "html"), "url").groupBy("url").agg(F.min("html").alias("html"))
        return read_pages(found).select("url", "title", "text", "links")

    return fetch


def crawled(seeds: DataFrame, fetch: Fetch, depth: int, most: int, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(url, depth, title, text, links) of a breadth-first crawl from ``seeds`` (url): ``depth`` rounds of links after the seeds.

    Of each round at most as many pages as ``most`` leaves, by url; links are followed that match ``include`` and not
    ``exclude``. A url is fetched once. Each round is a table in the shared folder."""
    wanted = seeds.select("url").where("url is not null").distinct()
    seen, pages, left = None, None, most
    for at in range(depth + 1):
        if seen is not None:
            wanted = wanted.join(seen, "url", "left_anti")
        wanted = cut(wanted.orderBy("url").limit(left), "crawl-wanted")
        got = cut(fetch(wanted).withColumn("depth", F.lit(at)), "crawl-pages")
        pages = got if pages is None else pages.unionByName(got)
        seen = wanted if seen is None else seen.unionByName(wanted)
        left -= wanted.count()
        links = got.select(F.explode("links").alias("url")).distinct()
        if include is not None:
            links = links.where(F.col("url").rlike(include))
        if exclude is not None:
            links = links.where(~F.col("url").rlike(exclude))
        wanted = links
        if left <= 0 or at == depth or links.isEmpty():
            break
    return pages.select("url", "depth", "title", "text", "links")


def stored(pages: DataFrame, as_of: str, least: int = 50, most: int = 50_000) -> dict[str, DataFrame]:
    """Documents for the chunked store, and interest in their hosts. Pages under ``least`` characters are dropped, longer ones cut at ``most``."""
    kept = pages.where(F.length(F.trim("text")) >= least)
    documents = kept.select(F.col("url").alias("id"), F.left("text", F.lit(most)).alias("content"), F.coalesce("title", "url").alias("title"))
    hosts = kept.select(F.regexp_extract("url", HOST, 1).alias("topic"), F.lit("crawl").alias("kind"))
    return {"documents": documents, "signals": signals_recorded(hosts, as_of)}


def crawl_batch(queue: DataFrame, seeds: DataFrame, sitemap: DataFrame, known: DataFrame, saturated: DataFrame, k: int) -> DataFrame:
    """(url, origin): the next k pages to read: the queue in its order (added_at), then unseen seeds, then the sitemap's; no page of a saturated host, none known."""
    rows = queue.where("crawled_at is null").select("url", F.lit("queue").alias("origin"), F.lit(0).alias("rank"), F.unix_micros("added_at").alias("ord"))
    for rank, (name, df) in enumerate((("seed", seeds), ("sitemap", sitemap)), 1):
        rows = rows.unionByName(df.select("url", F.lit(name).alias("origin"), F.lit(rank).alias("rank"), F.lit(0).cast("long").alias("ord")))
    w = Window.partitionBy("url").orderBy("rank", "ord")
    fresh = rows.join(known.select("url").distinct(), "url", "left_anti").withColumn("n", F.row_number().over(w)).where("n = 1")
    open_ = fresh.withColumn("domain", F.regexp_extract("url", HOST, 1)).join(saturated.select("domain").distinct(), "domain", "left_anti")
    return open_.orderBy("rank", "ord", "url").limit(k).select("url", "origin")
