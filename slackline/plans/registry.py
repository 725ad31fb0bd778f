"""Queries by name over the derived graph, each with the SQL that says the same.

SQL enumerates every source-to-sink path, or joins layer by layer: it shares nothing with the
plans it checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.functions import candidates as C
from slackline.operators import bitsets, graph, metrics, paths, selection
from slackline.operators.suffix import deviations, violated
from slackline.sources import derived

Query = Callable[[SparkSession, str], DataFrame]
K = 1000
cache = paths.StaticCache()


def index(spark: SparkSession, sf_dir: str) -> paths.PathIndex:
    return cache.get((spark.sparkContext.applicationId, sf_dir, derived.stamp(spark, sf_dir)), lambda: paths.PathIndex.build(derived.edges(spark, sf_dir)))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).tree.select("id", F.col("level").cast("long").alias("level"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    """Path nodes of no deviation, as parents at the vertices of their ways: the first expansion step alone."""
    i = index(spark, d)
    return i.roots.join(i.chains(i.roots).select("id", "u"), "id").select(F.col("id").alias("parent_id"), F.col("u").alias("src"), F.col("dist").alias("cost"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Path nodes of no or one deviation, as parents at the vertices of their last ways; ids tell source and deviation."""
    i = index(spark, d)
    none = _parents(spark, d).withColumn("parent_id", F.col("parent_id").cast("string"))
    one = none.join(i.devs.select("src", "dst", "delta"), "src").select(F.concat_ws("-", "parent_id", "src", "dst").alias("parent_id"), F.col("dst").alias("id"), (F.col("cost") + F.col("delta")).alias("cost"))
    ways = i.chains(one.select("id").distinct()).select("id", F.col("u").alias("src"))
    return none.unionByName(one.join(ways, "id").drop("id"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).devs.select((F.col("src") * 1_000_000_000 + F.col("dst")).alias("family_id"), "src", "dst", "delta")


def _made(spark: SparkSession, d: str, parents: Query = _parents) -> DataFrame:
    return selection.candidates(parents(spark, d), _families(spark, d))


SPLIT, FINAL = 500_000, 5_000_000


def _graph_stats(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return graph.graph_stats(i.edges, _levels(spark, d))


def _tile_classes(spark: SparkSession, d: str, parents: Query = _parents) -> DataFrame:
    f = _families(spark, d).groupBy("src").agg(F.min("delta").alias("dl"), F.max("delta").alias("dh"), F.count("*").alias("families"))
    p = parents(spark, d).groupBy("src").agg(F.min("cost").alias("pl"), F.max("cost").alias("ph"), F.count("*").alias("parents"))
    low, high, t, f_ = F.col("pl") + F.col("dl"), F.col("ph") + F.col("dh"), F.lit(True), F.lit(False)
    of = C.tile_class_of_bounds(low, high, F.lit(SPLIT), F.lit(FINAL), t, f_)
    short = C.short_only_class(F.col("pl"), F.col("ph"), F.col("dl"), F.col("dh"), F.lit(SPLIT))
    return f.join(p, "src").select("src", of.alias("tile_class"), short.alias("short_class"), C.tile_count(F.col("parents"), F.col("families"), F.lit(32), F.lit(16)).alias("tiles"))


def _per_source(spark: SparkSession, d: str, parents: Query = _parents) -> DataFrame:
    p = parents(spark, d).groupBy("src").agg(F.count("*").alias("parents"))
    return p.join(_families(spark, d).groupBy("src").agg(F.count("*").alias("families")), "src")


def _discover(spark: SparkSession, d: str) -> DataFrame:
    """Deviations that leave the cheapest way of any source."""
    devs = index(spark, d).devs
    active = _parents(spark, d).select(F.col("src").alias("id")).distinct()
    return bitsets.discover(bitsets.build(devs, row="dst", column="src"), active)


def _discover_all(spark: SparkSession, d: str) -> DataFrame:
    """Deviations found with every vertex that has one active."""
    devs = index(spark, d).devs
    return bitsets.discover(bitsets.build(devs, row="dst", column="src"), devs.select(F.col("src").alias("id")).distinct())


def _prefix_error(spark: SparkSession, d: str) -> DataFrame:
    """The approximation of at most one deviation against the exact costs."""
    i = index(spark, d)
    return metrics.cost_error(paths.topk_costs(i, K), paths.topk_costs(i, K, max_deviations=1), K)


def _prefix_compare(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    got = metrics.compare_prefix(paths.topk_costs(i, K), paths.topk_costs(i, K, max_deviations=1), K)
    return got.select("max_diff", "max_rank", "first_mismatch", "passed")


def may_emit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Deviations whose cheapest parent's candidate is within the final threshold, with its cost; parents are nodes of no or one deviation."""
    i = index(spark, d)
    least = _nodes(spark, d).groupBy("src").agg(F.min("cost").alias("parent"))
    at = lambda end, name: i.tree.select(F.col("id").alias(end), F.col("dist").alias(name))
    rows = i.devs.where(C.pair_valid(F.col("src"), F.col("dst"), F.col("src"))).join(least, "src").join(at("src", "ds"), "src").join(at("dst", "dd"), "dst")
    rows = rows.where(C.may_emit(F.col("parent"), F.col("ds"), F.col("dd"), F.col("w"), F.lit(SPLIT), F.lit(FINAL), F.lit(True), F.lit(False)))
    rows = rows.where(F.col("parent") <= C.parent_threshold(F.lit(FINAL), F.col("delta")))
    return rows.select("src", "dst", C.candidate_cost(F.col("parent"), F.col("ds"), F.col("dd"), F.col("w")).alias("least"))


def conservative_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tile classes that unreachable deviations would make uncertain; every deviation here is reachable."""
    all_devs = deviations(index(spark, d).edges, index(spark, d).tree, only_reachable=False).groupBy("src").agg(F.count("*").alias("devs"), F.count_if("reachable").alias("reachable_devs"))
    rows = _tile_classes(spark, d, _nodes).join(all_devs, "src").join(_per_source(spark, d, _nodes).select("src", (F.col("parents") * F.col("families")).alias("products")), "src")
    return rows.select("src", C.tile_class_conservative(F.col("products"), F.col("reachable_devs"), F.col("devs"), F.col("tile_class")).alias("tile_class"))


def _tile_audit(spark: SparkSession, d: str, parents: Query = _parents) -> DataFrame:
    """How many sources fall into each class by their bounds and by their counts."""
    n = selection.source_counts(parents(spark, d), _families(spark, d), SPLIT, FINAL)
    n = n.select("src", C.tile_class_of_counts(F.col("n_short"), F.col("n_long"), F.col("n_skip"), F.col("total")).alias("by_counts"))
    return _tile_classes(spark, d, parents).select("src", F.col("tile_class").alias("by_bounds")).join(n, "src").groupBy("by_bounds", "by_counts").agg(F.count("*").alias("n"))


def _dispatch(spark: SparkSession, d: str, parents: Query = _parents) -> DataFrame:
    """Sources and candidates by the reason why tiles are, or are not, worth it."""
    n = selection.source_counts(parents(spark, d), _families(spark, d), SPLIT, FINAL).join(_per_source(spark, d, parents), "src")
    room = C.tile_count(F.col("parents"), F.col("families"), F.lit(8), F.lit(2)) * 16
    of = n.select("total", C.dispatch(F.col("total"), F.col("n_short") + F.col("n_long"), room, min_products=20, min_fill=0.5, max_exact=0.05).alias("s"))
    return of.groupBy("s.dispatch", "s.reason").agg(F.count("*").alias("sources"), F.sum("total").alias("products"), F.sum("s.rejected").alias("rejected"))


def _tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the suffix tree looked up both ways round: one way is there, the other is not."""
    i = index(spark, d)
    down = i.tree.where("succ is not null").select(F.col("id").alias("src"), F.col("succ").alias("dst"))
    numbered = i.edges.withColumn("edge_id", F.col("src") * 1_000_000_000 + F.col("dst"))
    return selection.edge_lookup(down.unionByName(down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), numbered)


def _active(spark: SparkSession, d: str) -> DataFrame:
    """Slices of the graph that reach the sinks, with the bits they share."""
    edges = derived.edges(spark, d)
    return bitsets.active_slices(bitsets.build(edges), bitsets.frontier(graph.sinks(edges))).select("interval", "row_id", "hit")


def _increment(spark: SparkSession, d: str) -> DataFrame:
    return _graph_stats(spark, d).select(F.round(C.split_increment(F.col("n_edges") / F.col("n_vertices")), 6).alias("split_increment"))


QUERIES: dict[str, Query] = {
    "edges": lambda s, d: derived.edges(s, d),
    "sources": lambda s, d: graph.sources(derived.edges(s, d)),
    "sinks": lambda s, d: graph.sinks(derived.edges(s, d)),
    "degrees": lambda s, d: graph.degrees(derived.edges(s, d)),
    "topological_levels": _levels,
    "bfs_levels": lambda s, d: graph.bfs_levels(index(s, d).edges).select("id", F.col("level").cast("long").alias("level")),
    "level_pointers": lambda s, d: graph.level_pointers(_levels(s, d)),
    "level_spans": lambda s, d: graph.level_spans(index(s, d).edges, _levels(s, d)),
    "graph_stats": _graph_stats,
    "suffix_tree": lambda s, d: index(s, d).tree.select("id", "dist", F.coalesce("succ", F.lit(-1)).alias("succ")),
    "suffix_violations": lambda s, d: violated(index(s, d).edges, index(s, d).tree),
    "deviations": lambda s, d: deviations(index(s, d).edges, index(s, d).tree, only_reachable=False),
    "level_order": lambda s, d: graph.order_by_level(_levels(s, d)),
    "relabelled_edges": lambda s, d: graph.relabel(index(s, d).edges, graph.order_by_level(_levels(s, d))),
    "sized_up_edges": lambda s, d: graph.sized_up(derived.edges(s, d), 3, 1_000_000_000),
    "topk_costs": lambda s, d: paths.topk_costs(index(s, d), K),
    "topk_paths": lambda s, d: paths.topk_paths(index(s, d), K),
    "topk_paths_with_ties": lambda s, d: paths.topk_with_ties(index(s, d), 100),
    "topk_costs_one_deviation": lambda s, d: paths.topk_costs(index(s, d), K, max_deviations=1),
    "path_nodes": lambda s, d: paths.path_nodes(index(s, d), K),
    "path_levels_with_ties": lambda s, d: paths.candidate_paths(index(s, d), K).groupBy("level").agg(F.count("*").alias("n")),
    "paths_per_step": lambda s, d: metrics.paths_per_step(paths.topk_costs(index(s, d), K), 10_000),
    "candidates": lambda s, d: _made(s, d).select("parent_id", "src", "dst", "cost"),
    "candidate_classes": lambda s, d: selection.class_counts(_made(s, d), SPLIT, FINAL),
    "candidates_under_split": lambda s, d: selection.candidates(_parents(s, d), _families(s, d), SPLIT).select("parent_id", "src", "dst", "cost"),
    "candidates_first_with_ties": lambda s, d: selection.first_n_with_ties(_made(s, d), 200).select("parent_id", "src", "dst", "cost"),
    "family_counts": lambda s, d: selection.family_counts(_parents(s, d), _families(s, d), SPLIT, FINAL),
    "pile_summary": lambda s, d: selection.pile_summary(_made(s, d), SPLIT),
    "parent_order": lambda s, d: selection.in_source_order(_parents(s, d)).select("parent_id", "src", "cost", F.col("k").cast("long").alias("k")),
    "source_slots": lambda s, d: selection.source_slots(_families(s, d)).select("src", F.col("slot").cast("long").alias("slot")),
    "tile_classes": _tile_classes,
    "tile_stats": lambda s, d: selection.tile_stats(_per_source(s, d)),
    "bit_slices": lambda s, d: bitsets.build(derived.edges(s, d)),
    "bit_slice_summary": lambda s, d: bitsets.summary(bitsets.build(derived.edges(s, d))),
    "bit_slice_mismatches": lambda s, d: bitsets.mismatches(bitsets.build(derived.edges(s, d)), derived.edges(s, d)),
    "deviation_slices": lambda s, d: bitsets.build(index(s, d).devs, row="dst", column="src"),
    "deviation_discovery": _discover,
    "cost_error_one_deviation": _prefix_error,
    "prefix_comparison": _prefix_compare,
    "row_offsets": lambda s, d: graph.row_offsets(derived.edges(s, d)),
    "deviation_offsets": lambda s, d: graph.row_offsets(index(s, d).devs, index(s, d).tree),
    "dists_in_level_order": lambda s, d: graph.order_by_level(_levels(s, d)).join(index(s, d).tree, "id").select("new_id", "dist"),
    "gate_counts": lambda s, d: metrics.gate(index(s, d).edges, index(s, d).tree),
    "edge_lookup": _tree_edges,
    "paths_per_vertex": lambda s, d: paths.candidate_paths(index(s, d), K).groupBy("last").agg(F.count("*").alias("n")),
    "slice_chunks": lambda s, d: bitsets.pack(bitsets.build(derived.edges(s, d))),
    "active_slices": _active,
    "pulled_vertices": lambda s, d: bitsets.pull_step(bitsets.build(derived.edges(s, d)), graph.sinks(derived.edges(s, d)), graph.sinks(derived.edges(s, d))),
    "tile_audit": _tile_audit,
    "tile_dispatch": _dispatch,
    "split_increment": _increment,
    # The same over path nodes of no or one deviation, and over all vertices with deviations.
    "node_candidates": lambda s, d: _made(s, d, _nodes).select("parent_id", "src", "dst", "cost"),
    "node_candidate_classes": lambda s, d: selection.class_counts(_made(s, d, _nodes), SPLIT, FINAL),
    "node_candidates_under_split": lambda s, d: selection.candidates(_nodes(s, d), _families(s, d), SPLIT).select("parent_id", "src", "dst", "cost"),
    "node_candidates_first_with_ties": lambda s, d: selection.first_n_with_ties(_made(s, d, _nodes), 200).select("parent_id", "src", "dst", "cost"),
    "node_family_counts": lambda s, d: selection.family_counts(_nodes(s, d), _families(s, d), SPLIT, FINAL),
    "node_pile_summary": lambda s, d: selection.pile_summary(_made(s, d, _nodes), SPLIT),
    "node_parent_order": lambda s, d: selection.in_source_order(_nodes(s, d)).select("parent_id", "src", "cost", F.col("k").cast("long").alias("k")),
    "node_tile_classes": lambda s, d: _tile_classes(s, d, _nodes),
    "node_tile_stats": lambda s, d: selection.tile_stats(_per_source(s, d, _nodes)),
    "node_tile_audit": lambda s, d: _tile_audit(s, d, _nodes),
    "node_tile_dispatch": lambda s, d: _dispatch(s, d, _nodes),
    "node_deviation_discovery": _discover_all,
}

_E = derived.EDGES_SQL
_V = "vertices AS (SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges))"
#: Longest and shortest ways by edge count, and cheapest by cost, unrolled: the graph is six layers deep.
_UP = f"""{_E}, {_V},
snk AS (SELECT id FROM vertices WHERE id NOT IN (SELECT src FROM edges)),
way(id, n) AS (SELECT id, 0 FROM snk UNION SELECT e.src, way.n + 1 FROM way JOIN edges e ON e.dst = way.id),
topo AS (SELECT id, CAST(max(n) AS BIGINT) AS level FROM way GROUP BY id), bfs AS (SELECT id, CAST(min(n) AS BIGINT) AS level FROM way GROUP BY id)"""
_DIST = ", t0 AS MATERIALIZED (SELECT id, CAST(0 AS BIGINT) AS dist, CAST(NULL AS BIGINT) AS succ FROM snk)"
for _k in range(1, 6):
    _DIST += f""", t{_k} AS MATERIALIZED (SELECT * FROM t{_k - 1} UNION ALL SELECT x.id, x.dist, x.succ FROM (SELECT e.src AS id, min(e.w + t.dist) AS dist, arg_min(e.dst, (e.w + t.dist, e.dst)) AS succ
  FROM edges e JOIN topo ON topo.id = e.src AND topo.level = {_k} JOIN t{_k - 1} t ON t.id = e.dst GROUP BY e.src) x)"""
_TREE = f"{_UP}{_DIST}, tree AS MATERIALIZED (SELECT id, CAST(dist AS BIGINT) AS dist, succ FROM t5)"
_DEV = f"""{_TREE}, devs AS MATERIALIZED (SELECT e.src, e.dst, e.w, CAST(b.dist + e.w - a.dist AS BIGINT) AS delta, true AS reachable
  FROM edges e JOIN tree a ON a.id = e.src JOIN tree b ON b.id = e.dst WHERE a.succ IS DISTINCT FROM e.dst)"""
_CAND = f"""{_DEV}, src0 AS (SELECT id FROM vertices WHERE id NOT IN (SELECT dst FROM edges)),
chain(root, cost, u) AS (SELECT s.id, t.dist, s.id FROM src0 s JOIN tree t ON t.id = s.id UNION ALL SELECT c.root, c.cost, t.succ FROM chain c JOIN tree t ON t.id = c.u WHERE t.succ IS NOT NULL),
parents AS (SELECT root AS parent_id, u AS src, cost FROM chain),
families AS (SELECT src * 1000000000 + dst AS family_id, src, dst, delta FROM devs),
made AS (SELECT p.parent_id, f.family_id, p.src, f.dst, p.cost + f.delta AS cost FROM parents p JOIN families f ON f.src = p.src)"""
#: Nodes of no or one deviation by walking the edges: ``way`` are the vertices from the last deviation on, ``cost`` is known at the sink.
_NODE = f"""{_DEV}, marked AS (SELECT e.src, e.dst, e.w, t.succ IS DISTINCT FROM e.dst AS off FROM edges e JOIN tree t ON t.id = e.src),
hike(v, cost, level, name, way) AS (SELECT id, CAST(0 AS BIGINT), 0, CAST(id AS VARCHAR), [id] FROM vertices WHERE id NOT IN (SELECT dst FROM edges)
  UNION ALL SELECT m.dst, h.cost + m.w, h.level + CAST(m.off AS INT), CASE WHEN m.off THEN h.name || '-' || m.src || '-' || m.dst ELSE h.name END, CASE WHEN m.off THEN [m.dst] ELSE list_append(h.way, m.dst) END
  FROM hike h JOIN marked m ON m.src = h.v WHERE h.level + CAST(m.off AS INT) <= 1),
parents AS MATERIALIZED (SELECT name AS parent_id, unnest(way) AS src, cost FROM hike WHERE v IN (SELECT id FROM snk)),
families AS (SELECT src * 1000000000 + dst AS family_id, src, dst, delta FROM devs),
made AS (SELECT p.parent_id, f.family_id, p.src, f.dst, p.cost + f.delta AS cost FROM parents p JOIN families f ON f.src = p.src)"""
_ALL = f"""{_E}, {_V},
full_paths(v, cost, path) AS (SELECT id, CAST(0 AS BIGINT), CAST(id AS VARCHAR) FROM vertices WHERE id NOT IN (SELECT dst FROM edges)
  UNION ALL SELECT e.dst, p.cost + e.w, p.path || '-' || e.dst FROM full_paths p JOIN edges e ON e.src = p.v),
done AS (SELECT cost, path FROM full_paths WHERE v NOT IN (SELECT src FROM edges))"""
#: Paths with their number of deviations, to check the bounded approximation.
_COUNTED = f"""{_TREE}, marked AS (SELECT e.src, e.dst, e.w, CASE WHEN t.succ IS DISTINCT FROM e.dst THEN 1 ELSE 0 END AS off FROM edges e JOIN tree t ON t.id = e.src),
counted(v, cost, off) AS (SELECT id, CAST(0 AS BIGINT), 0 FROM vertices WHERE id NOT IN (SELECT dst FROM edges)
  UNION ALL SELECT m.dst, c.cost + m.w, c.off + m.off FROM counted c JOIN marked m ON m.src = c.v),
whole AS MATERIALIZED (SELECT cost, off FROM counted WHERE v IN (SELECT id FROM snk)),
exact AS (SELECT row_number() OVER (ORDER BY cost) AS rank, cost FROM whole ORDER BY cost LIMIT {K}),
near AS (SELECT row_number() OVER (ORDER BY cost) AS rank, cost FROM whole WHERE off <= 1 ORDER BY cost LIMIT {K})"""

_NAMED = f"""{_TREE}, marked AS (SELECT e.src, e.dst, e.w, CASE WHEN t.succ IS DISTINCT FROM e.dst THEN 1 ELSE 0 END AS off FROM edges e JOIN tree t ON t.id = e.src),
walk(v, cost, level, path) AS (SELECT id, CAST(0 AS BIGINT), 0, CAST(id AS VARCHAR) FROM vertices WHERE id NOT IN (SELECT dst FROM edges)
  UNION ALL SELECT m.dst, p.cost + m.w, p.level + m.off, p.path || '-' || m.dst FROM walk p JOIN marked m ON m.src = p.v),
named AS (SELECT cost, level, path FROM walk WHERE v IN (SELECT id FROM snk))"""

#: Paths with their deviations as text, as the engine orders ties.
_KEYED = f"""{_TREE}, marked AS (SELECT e.src, e.dst, e.w, t.succ IS DISTINCT FROM e.dst AS off FROM edges e JOIN tree t ON t.id = e.src),
trail(v, source, cost, level, devs, up, from_v, to_v) AS (SELECT id, id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '', CAST(-1 AS BIGINT), id FROM vertices WHERE id NOT IN (SELECT dst FROM edges)
  UNION ALL SELECT m.dst, p.source, p.cost + m.w, p.level + CAST(off AS INT), CASE WHEN off THEN p.devs || CASE WHEN p.devs = '' THEN '' ELSE ',' END || '{{"u":' || m.src || ',"v":' || m.dst || '}}' ELSE p.devs END,
    CASE WHEN off THEN p.devs ELSE p.up END, CASE WHEN off THEN m.src ELSE p.from_v END, CASE WHEN off THEN m.dst ELSE p.to_v END FROM trail p JOIN marked m ON m.src = p.v),
ended AS MATERIALIZED (SELECT * FROM trail WHERE v IN (SELECT id FROM snk)),
nodes AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cost, level, '{{"source":' || source || ',"devs":[' || devs || ']}}') - 1 AS node_id FROM ended QUALIFY node_id < {K})"""


def _with(ctes: str, query: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{query}"


def _tiles(m: int, n: int) -> str:
    return (
        f"CAST(sum((parents // {m}) * (families // {n})) AS BIGINT) AS full_{m}x{n}, CAST(sum(ceil(parents / {m}) * ceil(families / {n}) - (parents // {m}) * (families // {n})) AS BIGINT) AS partial_{m}x{n}, "
        f"CAST(sum(ceil(parents / {m}) * ceil(families / {n}) * {m * n}) AS BIGINT) AS capacity_{m}x{n}, "
        f"CAST(sum((SELECT coalesce(sum(least({m}, parents - i * {m}) * least({n}, families - j * {n})) FILTER (2 * least({m}, parents - i * {m}) * least({n}, families - j * {n}) >= {m * n}), 0) "
        f"FROM range(CAST(ceil(parents / {m}) AS BIGINT)) a(i), range(CAST(ceil(families / {n}) AS BIGINT)) b(j))) AS BIGINT) AS dense_{m}x{n}"
    )


_SHORT = f"cost <= {SPLIT}"
_LATE = f"cost > {FINAL}"
SQL: dict[str, str] = {
    "edges": _with(_E, "SELECT * FROM edges"),
    "sources": _with(f"{_E}, {_V}", "SELECT id FROM vertices EXCEPT SELECT dst FROM edges"),
    "sinks": _with(f"{_E}, {_V}", "SELECT id FROM vertices EXCEPT SELECT src FROM edges"),
    "degrees": _with(f"{_E}, {_V}", "SELECT id, (SELECT count(*) FROM edges WHERE src = id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = id) AS in_degree FROM vertices"),
    "topological_levels": _with(_UP, "SELECT * FROM topo"),
    "bfs_levels": _with(_UP, "SELECT * FROM bfs"),
    "level_pointers": _with(_UP, "SELECT level, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM topo GROUP BY level"),
    "level_spans": _with(_UP, "SELECT a.level - b.level AS span, count(*) AS n FROM edges e JOIN topo a ON a.id = e.src JOIN topo b ON b.id = e.dst GROUP BY 1"),
    "graph_stats": _with(_UP, "SELECT (SELECT count(*) FROM topo) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges, round((SELECT count(*) FROM edges) / (SELECT count(*) FROM topo), 4) AS avg_degree, (SELECT max(level) FROM topo) AS diameter"),
    "suffix_tree": _with(_TREE, "SELECT id, dist, coalesce(succ, -1) AS succ FROM tree"),
    "suffix_violations": _with(_TREE, "SELECT e.* FROM edges e JOIN tree a ON a.id = e.src JOIN tree b ON b.id = e.dst WHERE a.dist > e.w + b.dist"),
    "deviations": _with(_DEV, "SELECT * FROM devs"),
    "level_order": _with(_UP, "SELECT id, row_number() OVER (ORDER BY level, id) - 1 AS new_id FROM topo"),
    "relabelled_edges": _with(f"{_UP}, o AS (SELECT id, row_number() OVER (ORDER BY level, id) - 1 AS new_id FROM topo)", "SELECT a.new_id AS src, b.new_id AS dst, w FROM edges JOIN o a ON a.id = src JOIN o b ON b.id = dst"),
    "sized_up_edges": _with(_E, "SELECT src + 1000000000 * c AS src, dst + 1000000000 * c AS dst, w FROM edges, range(3) r(c)"),
    "topk_costs": _with(_ALL, f"SELECT row_number() OVER (ORDER BY cost) AS rank, cost FROM done ORDER BY cost LIMIT {K}"),
    "topk_paths": _with(_NAMED, f"SELECT row_number() OVER (ORDER BY cost, path) AS rank, cost, level, path FROM named ORDER BY cost, path LIMIT {K}"),
    "topk_paths_with_ties": _with(_ALL, "SELECT cost, path FROM done QUALIFY rank() OVER (ORDER BY cost) <= 100"),
    "path_levels_with_ties": _with(_NAMED, f"SELECT level, count(*) AS n FROM (SELECT level FROM named QUALIFY rank() OVER (ORDER BY cost) <= {K}) GROUP BY level"),
    "topk_costs_one_deviation": _with(_COUNTED, "SELECT * FROM near"),
    "paths_per_step": _with(_COUNTED, "SELECT CAST((cost - (SELECT min(cost) FROM exact)) // 10000 AS BIGINT) AS step, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM exact GROUP BY 1"),
    "candidates": _with(_CAND, "SELECT parent_id, src, dst, cost FROM made"),
    "candidate_classes": _with(_CAND, f"SELECT CASE WHEN {_SHORT} THEN 'SHORT' WHEN {_LATE} THEN 'SKIP' ELSE 'LONG' END AS class, count(*) AS n FROM made GROUP BY 1"),
    "candidates_under_split": _with(_CAND, f"SELECT parent_id, src, dst, cost FROM made WHERE {_SHORT}"),
    "candidates_first_with_ties": _with(_CAND, "SELECT parent_id, src, dst, cost FROM made QUALIFY rank() OVER (ORDER BY cost) <= 200"),
    "family_counts": _with(_CAND, f"SELECT family_id, count(*) FILTER ({_SHORT}) AS n_short, count(*) FILTER (NOT {_SHORT} AND NOT {_LATE}) AS n_long, count(*) FILTER ({_LATE}) AS n_skip, count(*) AS total FROM made GROUP BY family_id"),
    "pile_summary": _with(_CAND, f"SELECT min(cost) AS least, count(*) FILTER ({_SHORT}) AS n_within, count(*) FILTER (NOT {_SHORT}) AS n_beyond FROM made"),
    "parent_order": _with(_CAND, "SELECT *, row_number() OVER (PARTITION BY src ORDER BY cost, parent_id) AS k FROM parents"),
    "source_slots": _with(_CAND, "SELECT src, row_number() OVER (ORDER BY src) - 1 AS slot FROM (SELECT DISTINCT src FROM families)"),
    "tile_classes": _with(_CAND, f"""SELECT src, CASE WHEN hi <= {SPLIT} THEN 'ALL_SHORT' WHEN lo > {SPLIT} AND hi <= {FINAL} THEN 'ALL_LONG' WHEN lo > {SPLIT} AND lo > {FINAL} THEN 'ALL_SKIP' ELSE 'MIXED' END AS tile_class,
  CASE WHEN hi <= {SPLIT} THEN 'ALL_SHORT' WHEN lo > {SPLIT} THEN 'ALL_SKIP' ELSE 'MIXED' END AS short_class, CAST(ceil(np / 32) * ceil(nf / 16) AS BIGINT) AS tiles
  FROM (SELECT src, min(cost) AS lo, max(cost) AS hi, count(DISTINCT parent_id) AS np, count(DISTINCT family_id) AS nf FROM made GROUP BY src)"""),
    "tile_stats": _with(f"{_CAND}, per AS (SELECT src, count(DISTINCT parent_id) AS parents, count(DISTINCT family_id) AS families FROM made GROUP BY src)", "SELECT count(*) AS sources, CAST(sum(families) AS BIGINT) AS pairs, CAST(sum(parents) AS BIGINT) AS parents, CAST(sum(parents * families) AS BIGINT) AS products, max(parents) AS max_parents, max(families) AS max_families, max(parents * families) AS max_products, " + ", ".join(_tiles(*t) for t in ((16, 16), (16, 32), (32, 32))).replace("parents /", "per.parents /") + " FROM per"),
    "bit_slices": _with(_E, "SELECT dst // 8 AS interval, src AS row_id, bit_or(CAST(1 << (dst % 8) AS INT)) AS mask FROM edges GROUP BY 1, 2"),
    "bit_slice_summary": _with(f"{_E}, s AS (SELECT bit_or(CAST(1 << (dst % 8) AS INT)) AS mask FROM edges GROUP BY dst // 8, src)", "SELECT count(*) AS slices, CAST(sum(bit_count(mask)) AS BIGINT) AS bits, round(sum(bit_count(mask)) / (count(*) * 8), 6) AS ratio FROM s"),
    "bit_slice_mismatches": _with(f"""{_E}, s AS (SELECT dst // 8 AS interval, src AS row_id, bit_or(CAST(1 << (dst % 8) AS INT)) AS mask FROM edges GROUP BY 1, 2),
told AS (SELECT row_id AS src, interval * 8 + b AS dst FROM s, range(8) r(b) WHERE (mask >> CAST(b AS INT)) & 1 = 1)""", "(SELECT src, dst FROM told EXCEPT SELECT src, dst FROM edges) UNION ALL (SELECT src, dst FROM edges EXCEPT SELECT src, dst FROM told)"),
    "deviation_slices": _with(_DEV, "SELECT src // 8 AS interval, dst AS row_id, bit_or(CAST(1 << (src % 8) AS INT)) AS mask FROM devs GROUP BY 1, 2"),
    "deviation_discovery": _with(_CAND, "SELECT src, dst FROM devs WHERE src IN (SELECT u FROM chain)"),
    "cost_error_one_deviation": _with(_COUNTED, f"SELECT round(sum(abs(n.cost - e.cost) / e.cost * 100) / {K}, 6) AS avg_error_pct, round(max(abs(n.cost - e.cost) / e.cost * 100), 6) AS max_error_pct FROM exact e JOIN near n USING (rank) WHERE e.cost > 0"),
    "prefix_comparison": _with(f"{_COUNTED}, off_by AS (SELECT rank, coalesce(abs(n.cost - e.cost), {2**62}) AS d FROM exact e FULL JOIN near n USING (rank))", "SELECT max(d) AS max_diff, arg_max(rank, (d, -rank)) AS max_rank, min(rank) FILTER (d > 10) AS first_mismatch, min(rank) FILTER (d > 10) IS NULL AS passed FROM off_by"),
    "row_offsets": _with(f"{_E}, {_V}, n AS (SELECT id, (SELECT count(*) FROM edges WHERE src = id) AS n FROM vertices)", "SELECT id, CAST(coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM n"),
    "deviation_offsets": _with(f"{_DEV}, n AS (SELECT id, (SELECT count(*) FROM devs WHERE src = id) AS n FROM vertices)", "SELECT id, CAST(coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM n"),
    "dists_in_level_order": _with(_TREE, "SELECT row_number() OVER (ORDER BY level, id) - 1 AS new_id, dist FROM topo JOIN tree USING (id)"),
    "gate_counts": _with(f"""{_TREE}, met AS (SELECT e.dst, e.w, a.dist AS ds, a.succ, x.level AS ls, b.dist AS dd, y.level AS ld FROM edges e
  JOIN tree a ON a.id = e.src JOIN topo x ON x.id = e.src JOIN tree b ON b.id = e.dst JOIN topo y ON y.id = e.dst)""", """SELECT (SELECT count(*) FROM vertices) AS n_vertices, (SELECT count(*) FROM tree JOIN topo USING (id) WHERE succ IS NULL AND (dist <> 0 OR level <> 0)) AS bad_sinks,
  count(*) AS n_edges, count(*) FILTER (ls <= ld) AS bad_levels, count(*) FILTER (ds > w + dd) AS not_least, count(*) FILTER (dst = succ AND ds <> w + dd) AS bad_successors FROM met"""),
    "edge_lookup": _with(_TREE, "SELECT src, dst, src * 1000000000 + dst AS edge_id, w FROM edges JOIN tree ON id = src AND succ = dst UNION ALL SELECT succ, id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM tree WHERE succ IS NOT NULL"),
    "paths_per_vertex": _with(_KEYED, f"SELECT to_v AS last, count(*) AS n FROM (SELECT to_v FROM ended QUALIFY rank() OVER (ORDER BY cost) <= {K}) GROUP BY 1"),
    "path_nodes": _with(_KEYED, "SELECT a.node_id, a.level, a.from_v, a.to_v, coalesce(p.node_id, -1) AS parent, (SELECT count(*) FROM nodes c WHERE c.level > 0 AND c.source = a.source AND c.up = a.devs) AS n_children, a.cost AS slack FROM nodes a LEFT JOIN nodes p ON a.level > 0 AND p.source = a.source AND p.devs = a.up"),
    "slice_chunks": _with(f"{_E}, s AS (SELECT dst // 8 AS interval, src AS row_id, bit_or(CAST(1 << (dst % 8) AS INT)) AS mask FROM edges GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY interval ORDER BY row_id) - 1 AS INT) AS k FROM s)", "SELECT interval, CAST(k // 128 AS INT) AS chunk, CAST(k % 128 AS INT) AS slot, CAST(k % 32 AS INT) AS lane, row_id, mask FROM k"),
    "active_slices": _with(_UP, "SELECT dst // 8 AS interval, src AS row_id, bit_or(CAST(1 << (dst % 8) AS INT)) AS hit FROM edges WHERE dst IN (SELECT id FROM snk) GROUP BY 1, 2"),
    "pulled_vertices": _with(_UP, "SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM snk)"),
    "tile_audit": _with(_CAND, f"""SELECT CASE WHEN hi <= {SPLIT} THEN 'ALL_SHORT' WHEN lo > {SPLIT} AND hi <= {FINAL} THEN 'ALL_LONG' WHEN lo > {SPLIT} AND lo > {FINAL} THEN 'ALL_SKIP' ELSE 'MIXED' END AS by_bounds,
  CASE WHEN skip = total THEN 'ALL_SKIP' WHEN short = total THEN 'ALL_SHORT' WHEN short = 0 AND skip = 0 THEN 'ALL_LONG' ELSE 'MIXED' END AS by_counts, count(*) AS n
  FROM (SELECT src, min(cost) AS lo, max(cost) AS hi, count(*) FILTER ({_SHORT}) AS short, count(*) FILTER ({_LATE}) AS skip, count(*) AS total FROM made GROUP BY src) GROUP BY 1, 2"""),
    "tile_dispatch": _with(_CAND, f"""SELECT reason = 'selected' AS dispatch, reason, count(*) AS sources, CAST(sum(total) AS BIGINT) AS products, CAST(sum(total - exact) AS BIGINT) AS rejected FROM (
  SELECT *, CASE WHEN total < 20 THEN 'too_few_products' WHEN total / (ceil(np / 8) * ceil(nf / 2) * 16) < 0.5 THEN 'low_tile_fill' WHEN exact / total > 0.05 THEN 'high_exact_fraction' ELSE 'selected' END AS reason
  FROM (SELECT src, count(*) AS total, count(*) FILTER (NOT {_LATE}) AS exact, count(DISTINCT parent_id) AS np, count(DISTINCT family_id) AS nf FROM made GROUP BY src)) GROUP BY 1, 2"""),
    "split_increment": _with(f"{_E}, {_V}", "SELECT round(0.1 + 99.9 / (1 + exp(0.8 * ((SELECT count(*) FROM edges) / (SELECT count(*) FROM vertices) - 3))), 6) AS split_increment"),
}
for _n in [n.removeprefix("node_") for n in QUERIES if n.startswith("node_")]:
    SQL[f"node_{_n}"] = SQL[_n].replace(_CAND.strip(), _NODE.strip())
SQL["node_deviation_discovery"] = _with(_DEV, "SELECT src, dst FROM devs")
