"""Registered graph queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from slackline.plans import files, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", ["edges", "degrees", "suffix_tree", "deviations", "topk_paths", "topk_paths_with_ties", "family_counts", "tile_stats", "deviation_discovery", "prefix_comparison", "path_nodes", "row_offsets", "paths_per_vertex", "tile_audit", "edge_lookup"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    queries, sql = {**registry.QUERIES, **files.QUERIES}, {**registry.SQL, **files.SQL}
    got = queries[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


@pytest.mark.parametrize("name", list(files.QUERIES))
def test_files_same_as_sql(spark, name):
    test_same_as_sql(spark, name)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n.startswith("node_")])
def test_nodes_same_as_sql(spark, name):
    test_same_as_sql(spark, name)


def test_nodes_hold_one_deviation(spark):
    i = registry.index(spark, DATA)
    met = i.roots.join(i.chains(i.roots).select("id", "u"), "id").join(i.devs.withColumnRenamed("src", "u"), "u").count()
    got = registry.QUERIES["node_parent_order"](spark, DATA).select("parent_id").distinct().collect()
    assert met > 0
    assert sum(r["parent_id"].count("-") == 2 for r in got) == met
    assert sum("-" not in r["parent_id"] for r in got) == i.roots.count()
    assert registry.QUERIES["node_deviation_discovery"](spark, DATA).count() == i.devs.count()
