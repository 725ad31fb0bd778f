"""Queries that write the derived graph in each text or table form and read it back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.functions.candidates import SCALE
from slackline.operators import graph, metrics, paths, selection
from slackline.plans import registry as R
from slackline.plans.scratch import Scratch
from slackline.sources import derived, graph_text

UNIT, DEGREE = 7, 8


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, "files").path(name)


def _dense(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph with ids from 0, by level and id; edges point to lesser ids."""
    levels = R._levels(spark, d)
    return spark.range(levels.count()), graph.relabel(R.index(spark, d).edges, graph.order_by_level(levels))


def _text(spark: SparkSession, d: str, ignore_weights: bool = False) -> DataFrame:
    path = _folder(spark, "graph")
    graph_text.write_graph(*_dense(spark, d), path)
    return graph_text.read_graph(spark, path, default_weight=float(UNIT), ignore_weights=ignore_weights)[1]


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "unit")
    vertices, edges = _dense(spark, d)
    graph_text.write_graph(vertices, graph.with_weights(edges, unit=UNIT * SCALE), path)
    return graph_text.read_graph(spark, path)[1]


def _outside(spark: SparkSession, d: str) -> DataFrame:
    vertices, edges = _dense(spark, d)
    return graph_text.out_of_range(edges, vertices.count() // 2)


def _dimacs(spark: SparkSession, d: str) -> DataFrame:
    """Through lines of neighbours, from 1, each edge at both ends."""
    path = _folder(spark, "dimacs")
    vertices, edges = _dense(spark, d)
    ends = edges.select("src", "dst").union(edges.select("dst", "src")).groupBy(F.col("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.col("dst") + 1)).cast("array<string>"), " ").alias("value"))
    head = spark.createDataFrame([(-1, f"{vertices.count()} {edges.count()}")], "id long, value string")
    rows = head.union(vertices.join(ends, "id", "left").select("id", F.coalesce("value", F.lit(""))))
    rows.orderBy("id").select("value").write.text(path)
    return graph_text.read_dimacs(spark, path)


def _timing(spark: SparkSession, d: str) -> DataFrame:
    """Every raw edge, parallel ones as well, as a line of eight delays of which two are numbers."""
    path = _folder(spark, "timing")
    raw = derived.raw_edges(spark, d)
    lines = raw.select(F.format_string("insert_edge n%d n%d n/a %.4f n/a n/a %.4f n/a n/a n/a", "src", "dst", F.col("w") / SCALE, F.col("w") / SCALE + 1).alias("value"))
    lines.union(spark.createDataFrame([("# delays",), ("remove_edge n1 n2",)], "value string")).write.text(path)
    vertices, edges = graph_text.read_timing_edges(spark, path)
    name = lambda s: vertices.select(F.col("id").alias(s), F.expr("cast(substring(name, 2) as long)").alias(f"{s}_"))
    return edges.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_").alias("src"), F.col("dst_").alias("dst"), "w")


def _csr(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csr")
    vertices, edges = _dense(spark, d)
    graph_text.write_csr(edges, vertices, path)
    return graph_text.read_csr(spark, path)[1]


def _densify(spark: SparkSession, d: str) -> DataFrame:
    """n_edges, n_lost, n_off_level: how many there are, old ones that are gone, new ones not between neighbouring levels."""
    i, levels = R.index(spark, d), R._levels(spark, d)
    made = Scratch(spark, "files").save(graph.densified(i.edges, levels, DEGREE), "dense")
    lost = i.edges.join(made, ["src", "dst"], "left_anti").agg(F.count("*").alias("n_lost"))
    spans = graph.level_spans(made.join(i.edges.select("src", "dst"), ["src", "dst"], "left_anti"), levels).where("span <> 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_off_level"))
    return made.agg(F.count("*").alias("n_edges")).join(lost).join(spans)  # of one row each


def _dumped(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "dumps")
    i = R.index(spark, d)
    graph_text.write_dumps(i.edges, i.tree, path)
    return path


def _loaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    path = _dumped(spark, d)
    return graph_text.load_dumps(spark, f"{path}/suffix", f"{path}/edge_list_weighted", f"{path}/levels")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "map")
    graph_text.write_dump(graph.order_by_level(R._levels(spark, d)), path)
    return graph.relabel(R.index(spark, d).edges, graph_text.read_vertex_map(spark, path))


def _captured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = _folder(spark, "capture")
    graph_text.write_capture(R._parents(spark, d), R._families(spark, d), path)
    return graph_text.read_capture(spark, path)


def _costs(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "costs")
    graph_text.write_costs(paths.topk_costs(R.index(spark, d), R.K), path)
    return graph_text.read_costs(spark, path)


def _hops(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "hops")
    hops = R.index(spark, d).tree.where("succ is not null").select("id", "succ", F.format_string("%.4f", F.col("dist") / SCALE))
    graph_text.write_dump(hops.union(hops.limit(5)), path)
    return graph_text.read_hops(spark, path).distinct()


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of results in one table with a header."""
    path = _folder(spark, "results")
    for k in (1, 2):
        row = R.index(spark, d).edges.agg(F.count("*").alias("n_edges")).select(graph_text.base_name(F.lit("/graphs/star.v1.txt")).alias("name"), F.lit(k).alias("run"), "n_edges")
        graph_text.append_results(row, path)
    return spark.read.csv(path, header=True, schema="name string, run int, n_edges long")


def _timings(spark: SparkSession, d: str) -> DataFrame:
    """The timing summary over order totals in place of runs."""
    runs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("name"), F.round(F.col("o_totalprice")).alias("ms"))
    return metrics.timing_summary(runs).select("name", F.round("mean", 4).alias("mean"), "least", "most", "median")


QUERIES: dict[str, R.Query] = {
    "read_graph_text": _text,
    "read_graph_without_weights": lambda s, d: _text(s, d, ignore_weights=True),
    "read_unit_weights": _weighted,
    "edges_out_of_range": _outside,
    "read_adjacency_lists": _dimacs,
    "read_timing_edges": _timing,
    "read_csr": _csr,
    "densified_summary": _densify,
    "loaded_distances": lambda s, d: _loaded(s, d)[0],
    "loaded_edges": lambda s, d: _loaded(s, d)[1],
    "loaded_levels": lambda s, d: _loaded(s, d)[2].select("id", F.col("level").cast("long").alias("level")),
    "read_edge_list": lambda s, d: s.read.csv(f"{_dumped(s, d)}/edge_list", sep=" ", schema="src long, dst long"),
    "read_scaled_edges": lambda s, d: s.read.csv(f"{_dumped(s, d)}/edges_transformed", sep=" ", schema="src long, dst long, w long"),
    "read_level_sizes": lambda s, d: s.read.csv(f"{_dumped(s, d)}/level_sizes", sep=" ", schema="level long, n long, first long"),
    "read_successors": lambda s, d: graph_text.read_successors(s, f"{_dumped(s, d)}/successors").select("id", F.coalesce("succ", F.lit(-1)).alias("succ"), "dist"),
    "read_vertex_map": _mapped,
    "captured_families": lambda s, d: _captured(s, d)[1],
    "captured_parents": lambda s, d: _captured(s, d)[0],
    "read_costs": _costs,
    "read_hops": _hops,
    "read_results": _results,
    "timing_summary": _timings,
    "sorted_adjacency": lambda s, d: graph.sorted_edges(R.index(s, d).edges),
    "degree_extremes": lambda s, d: graph.degree_extremes(R.index(s, d).edges),
    "unvisited": lambda s, d: metrics.unvisited(graph.bfs_levels(R.index(s, d).edges, R.index(s, d).tree.select("id").union(s.range(900_000_000_000, 900_000_000_003))).select(F.col("level").alias("depth"))),
    "compact_deviations": lambda s, d: R.deviations(R.index(s, d).edges, R.index(s, d).tree).select("src", "dst", "delta"),
    "promoted_candidates": lambda s, d: selection.promote(R._made(s, d, R._nodes), R.FINAL)[0].select("parent_id", "src", "dst", "cost"),
    "candidates_in_order": lambda s, d: selection.first_n(R._made(s, d, R._nodes), 300).select("rank", "parent_id", "src", "dst", "cost"),
    "pairs_that_may_emit": R.may_emit_pairs,
    "conservative_tiles": R.conservative_tiles,
}

_DENSE = f"{R._UP}, o AS (SELECT id, row_number() OVER (ORDER BY level, id) - 1 AS new_id FROM topo), dense AS (SELECT a.new_id AS src, b.new_id AS dst, w FROM edges JOIN o a ON a.id = src JOIN o b ON b.id = dst)"
_W, _ORDERED = R._with, "SELECT row_number() OVER (ORDER BY cost, parent_id, family_id) AS rank, parent_id, src, dst, cost FROM made ORDER BY cost, parent_id, family_id LIMIT 300"
SQL: dict[str, str] = {
    "read_graph_text": _W(_DENSE, "SELECT * FROM dense"),
    "read_graph_without_weights": _W(_DENSE, f"SELECT src, dst, CAST({UNIT * SCALE} AS BIGINT) AS w FROM dense"),
    "read_unit_weights": _W(_DENSE, f"SELECT src, dst, CAST({UNIT * SCALE} AS BIGINT) AS w FROM dense"),
    "edges_out_of_range": _W(_DENSE, "SELECT * FROM dense WHERE greatest(src, dst) >= (SELECT count(*) // 2 FROM vertices)"),
    "read_adjacency_lists": _W(_DENSE, "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM dense"),
    "read_timing_edges": _W(R._E, "SELECT * FROM edges"),
    "read_csr": _W(_DENSE, "SELECT * FROM dense"),
    "densified_summary": _W(f"{R._E}, {R._V}", f"SELECT {DEGREE} * count(*) AS n_edges, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_off_level FROM vertices"),
    "loaded_distances": _W(R._TREE, "SELECT id, dist FROM tree"),
    "loaded_edges": _W(R._E, "SELECT * FROM edges"),
    "loaded_levels": _W(R._UP, "SELECT * FROM topo"),
    "read_edge_list": _W(R._E, "SELECT src, dst FROM edges"),
    "read_scaled_edges": _W(R._E, "SELECT * FROM edges"),
    "read_level_sizes": R.SQL["level_pointers"],
    "read_successors": _W(R._TREE, "SELECT id, coalesce(succ, -1) AS succ, dist FROM tree"),
    "read_vertex_map": _W(_DENSE, "SELECT * FROM dense"),
    "captured_families": _W(R._CAND, "SELECT * FROM families"),
    "captured_parents": _W(R._CAND, "SELECT * FROM parents"),
    "read_costs": R.SQL["topk_costs"],
    "read_hops": _W(R._TREE, "SELECT id AS src, succ, dist AS cost FROM tree WHERE succ IS NOT NULL"),
    "read_results": _W(R._E, "SELECT 'star' AS name, CAST(k AS INT) AS run, (SELECT count(*) FROM edges) AS n_edges FROM range(1, 3) r(k)"),
    "timing_summary": "SELECT o_orderpriority AS name, round(avg(round(o_totalprice)), 4) AS mean, min(round(o_totalprice)) AS least, max(round(o_totalprice)) AS most, median(round(o_totalprice)) AS median FROM orders GROUP BY 1",
    "sorted_adjacency": _W(R._E, "SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, dst, w FROM edges"),
    "degree_extremes": _W(R._E, "SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM edges GROUP BY src)) AS max_out_degree, (SELECT max(n) FROM (SELECT count(*) AS n FROM edges GROUP BY dst)) AS max_in_degree"),
    "unvisited": "SELECT CAST(0 AS BIGINT) AS n",
    "compact_deviations": _W(R._DEV, "SELECT src, dst, delta FROM devs"),
    "promoted_candidates": _W(R._NODE, f"SELECT parent_id, src, dst, cost FROM made WHERE cost <= {R.FINAL}"),
    "candidates_in_order": _W(R._NODE, _ORDERED),
    "pairs_that_may_emit": _W(R._NODE, f"SELECT src, dst, min(cost) AS least FROM made GROUP BY src, dst HAVING min(cost) <= {R.FINAL}"),
    "conservative_tiles": _W(R._NODE, f"""SELECT src, CASE WHEN hi <= {R.SPLIT} THEN 'ALL_SHORT' WHEN lo > {R.SPLIT} AND hi <= {R.FINAL} THEN 'ALL_LONG' WHEN lo > {R.SPLIT} AND lo > {R.FINAL} THEN 'ALL_SKIP' ELSE 'MIXED' END AS tile_class
  FROM (SELECT src, min(cost) AS lo, max(cost) AS hi FROM made GROUP BY src)"""),
}
