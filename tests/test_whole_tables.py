"""All queries read links and relations of all lineitem rows."""

import pandas as pd

from engram.plans import catalog, catalog_jobs, catalog_more, catalog_rest  # noqa: F401
from engram.plans.fixtures import Tables

DATA = "/root/testdata/sf0.001"


def relations() -> pd.DataFrame:
    rows, n = pd.read_parquet(f"{DATA}/lineitem.parquet"), len(pd.read_parquet(f"{DATA}/supplier.parquet"))
    rows = rows.assign(s=rows.l_suppkey, t=rows.l_partkey * 7 % n, k=rows.l_partkey % 5)
    return rows.groupby(["s", "t", "k"], as_index=False)["l_tax"].min()


def test_all_rows_are_read(spark):
    t = Tables(spark, DATA)
    want = relations()
    got = t.entity_relations
    assert got.count() == len(want) == got.select("id").distinct().count() and got.where("valid").count() == (want.l_tax < 0.07).sum()
    lines, n = pd.read_parquet(f"{DATA}/lineitem.parquet"), len(pd.read_parquet(f"{DATA}/documents.parquet"))
    assert t.entity_memories.count() == len(set(zip(lines.l_orderkey % n, lines.l_suppkey)))
    assert t.part_links.count() == len(set(zip(lines.l_orderkey % n, lines.l_partkey)))


def test_whole_components(spark):
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in relations().query("l_tax < 0.07 and s != t").itertuples():
        a, b = sorted((root(r.s), root(r.t)))
        parent[b] = a
    want = {x: root(x) for x in parent}
    assert {r.node: r.component for r in catalog.QUERIES["connected_components"](spark, DATA).collect()} == want
    assert sum(r.members for r in catalog.QUERIES["component_sizes"](spark, DATA).collect()) == len(want)


def test_queries_without_sql_read_whole_tables(spark):
    ends = relations().query("l_tax < 0.07 and s != t")
    assert {r.node for r in catalog.QUERIES["communities"](spark, DATA).collect()} == set(ends.s) | set(ends.t)
