"""Nested, cyclic, gzipped and broken sitemaps; robots rules by longest match."""

import gzip

from engram.sources import sitemaps

INDEX = '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">%s</sitemapindex>'
MAP = "<urlset>%s</urlset>"


def sm(*urls):
    return "".join(f"<sitemap><loc> {u} </loc></sitemap>" for u in urls)


def pages(*urls):
    return "".join(f"<url><loc>{u}</loc><priority>1</priority></url>" for u in urls)


def test_nested_cyclic_and_gzipped(spark):
    files = [
        ("https://a.org/index.xml", (INDEX % sm("https://a.org/one.xml.gz", "https://a.org/more.xml", "https://a.org/gone.xml")).encode()),
        ("https://a.org/more.xml", (INDEX % sm("https://a.org/index.xml", "https://a.org/two.xml", "https://a.org/broken.gz")).encode()),
        ("https://a.org/one.xml.gz", gzip.compress((MAP % pages("https://a.org/p1", "https://a.org/p2?x=1&amp;y=2", "/relative", "")).encode())),
        ("https://a.org/two.xml", (MAP % pages("https://a.org/p1", "<![CDATA[https://a.org/p3]]>")).encode()),
        ("https://a.org/broken.gz", b"\x1f\x8bnot gzip"), ("https://a.org/other.xml", (MAP % pages("https://a.org/p9")).encode()), ("https://a.org/null.xml", None),
    ]
    df = spark.createDataFrame(files, "url string, body binary")
    roots = spark.createDataFrame([("https://a.org/index.xml",), ("https://a.org/null.xml",), (None,)], "url string")
    got = {(r.url, r.sitemap, r.round) for r in sitemaps.sitemap_pages(df, roots).collect()}
    assert got == {("https://a.org/p1", "https://a.org/one.xml.gz", 1), ("https://a.org/p2?x=1&y=2", "https://a.org/one.xml.gz", 1), ("https://a.org/p3", "https://a.org/two.xml", 2)}
    assert {r.url for r in sitemaps.sitemap_pages(df, roots, rounds=2).collect()} == {"https://a.org/p1", "https://a.org/p2?x=1&y=2"}
    assert [r.url for r in sitemaps.sitemap_errors(df).collect()] == ["https://a.org/broken.gz"]
    assert sitemaps.sitemap_pages(df, roots.limit(0)).count() == 0


ROBOTS = """# all
User-agent: other
Disallow: /

User-agent: *
User-agent: bot
Disallow: /private
Allow: /private/open   # longer
Disallow: /*.pdf$
Disallow: /search?q=
Allow: /same
Disallow: /same
Disallow:
Sitemap: https://a.org/index.xml
"""


def test_robots(spark):
    files = spark.createDataFrame([("a.org", ROBOTS), ("b.org", None)], "host string, text string")
    rules = sitemaps.robots_rules(files)
    assert [r.sitemap for r in rules.where("sitemap is not null").collect()] == ["https://a.org/index.xml"]
    want = {
        "https://a.org": True, "https://a.org/": True, "https://a.org/private": False, "https://a.org/privateer": False, "https://a.org/private/open/x": True, "http://A.org/x.pdf": False, "https://a.org/x.pdf?v=1": True,
        "https://a.org/search?q=1": False, "https://a.org/search": True, "https://a.org/same/x": True, "https://b.org/private": True, "https://c.org/": True,
    }
    urls = spark.createDataFrame([(u, "clash") for u in [*want, "https://a.org/private"]], "url string, host string")
    rows = sitemaps.allowed(urls, rules).collect()
    assert len(rows) == len(want) + 1 and {r.url: r.allowed for r in rows} == want
    assert {r.allowed for r in sitemaps.allowed(urls, sitemaps.robots_rules(files, "other")).where("url like '%a.org%'").collect()} == {False}
