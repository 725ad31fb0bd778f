"""The layered graph inside the star schema: region, nation, customer, order, part, supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.operators.graph import collapse_parallel

STRIDE = 100_000_000


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w before parallel edges are collapsed; ids are layer * STRIDE + key."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    at = lambda layer, key: (F.lit(layer * STRIDE) + F.col(key)).cast("long")
    money = lambda c, up=0: F.round((F.col(c) + up) * 100).cast("long")
    lines = read("lineitem")
    parts = [
        read("nation").select(at(0, "n_regionkey").alias("src"), at(1, "n_nationkey").alias("dst"), F.lit(10_000).cast("long").alias("w")),
        read("customer").select(at(1, "c_nationkey"), at(2, "c_custkey"), money("c_acctbal", 1000)),
        read("orders").select(at(2, "o_custkey"), at(3, "o_orderkey"), money("o_totalprice")),
        lines.select(at(3, "l_orderkey"), at(4, "l_partkey"), money("l_extendedprice")),
        lines.select(at(4, "l_partkey"), at(5, "l_suppkey"), F.round(F.col("l_quantity") * 10_000).cast("long")),
        read("supplier").select(at(1, "s_nationkey"), at(5, "s_suppkey"), money("s_acctbal", 1000)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


TABLES = "nation", "customer", "orders", "lineitem", "supplier"


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """What changes when a table's files do."""
    out = []
    for t in TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((store.getFileStatus(path).getModificationTime(), store.getContentSummary(path).getLength()))
    return tuple(out)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_parallel(raw_edges(spark, sf_dir))


EDGES_SQL = f"""
raw AS (SELECT CAST(n_regionkey AS BIGINT) AS src, CAST({STRIDE} + n_nationkey AS BIGINT) AS dst, CAST(10000 AS BIGINT) AS w FROM nation
  UNION ALL SELECT {STRIDE} + c_nationkey, 2 * {STRIDE} + c_custkey, CAST(round((c_acctbal + 1000) * 100) AS BIGINT) FROM customer
  UNION ALL SELECT 2 * {STRIDE} + o_custkey, 3 * {STRIDE} + o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders
  UNION ALL SELECT 3 * {STRIDE} + l_orderkey, 4 * {STRIDE} + l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem
  UNION ALL SELECT 4 * {STRIDE} + l_partkey, 5 * {STRIDE} + l_suppkey, CAST(round(l_quantity * 10000) AS BIGINT) FROM lineitem
  UNION ALL SELECT {STRIDE} + s_nationkey, 5 * {STRIDE} + s_suppkey, CAST(round((s_acctbal + 1000) * 100) AS BIGINT) FROM supplier),
edges AS MATERIALIZED (SELECT src, dst, CAST(min(w) AS BIGINT) AS w FROM raw GROUP BY src, dst)"""
