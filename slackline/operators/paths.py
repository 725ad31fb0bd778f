"""The K cheapest source-to-sink paths, by rounds of deviations under a falling bound."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.operators.graph import degrees
from slackline.operators.suffix import chain_arrays, deviations, successor_jumps, suffix_chains, suffix_tree
from slackline.plans.phases import Phases
from slackline.plans.scratch import Scratch


class PathIndex:
    """What queries on one graph share; each part is a written table, made when it is first asked for."""

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None):
        self.given, self.vertices = edges, vertices
        self.scratch = Scratch(edges.sparkSession, "paths")
        self.phases = Phases()

    @classmethod
    def build(cls, edges: DataFrame, vertices: DataFrame | None = None) -> PathIndex:
        return cls(edges, vertices)

    def _made(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self.phases.of(name):
            return self.scratch.save(make(), name)

    @cached_property
    def edges(self) -> DataFrame:
        return self._made("edges", lambda: self.given.select("src", "dst", "w"))

    @cached_property
    def degrees(self) -> DataFrame:
        edges = self.edges
        return self._made("degrees", lambda: degrees(edges, self.vertices))

    @cached_property
    def tree(self) -> DataFrame:
        edges, degree = self.edges, self.degrees
        with self.phases.of("tree"):
            return suffix_tree(edges, self.vertices, self.scratch, degree)

    @cached_property
    def devs(self) -> DataFrame:
        edges, tree = self.edges, self.tree
        return self._made("devs", lambda: deviations(edges, tree))

    @cached_property
    def roots(self) -> DataFrame:
        tree, degree = self.tree, self.degrees
        return self._made("roots", lambda: degree.where("in_degree = 0").select("id").join(tree, "id").select("id", "dist"))

    @cached_property
    def jumps(self) -> list[DataFrame]:
        tree = self.tree
        with self.phases.of("jumps"):
            return successor_jumps(tree, self.scratch)

    def chains(self, ids: DataFrame) -> DataFrame:
        """id, u, pos: the ways of ``ids(id)`` along the tree."""
        return suffix_chains(ids, self.jumps, self.scratch)


class StaticCache:
    """Path indexes by key, with counts of hits and misses."""

    def __init__(self) -> None:
        self.held: dict[tuple, PathIndex] = {}
        self.hits = self.misses = 0

    def get(self, key: tuple, make) -> PathIndex:
        if key in self.held:
            self.hits += 1
        else:
            self.misses += 1
            self.held[key] = make()
        return self.held[key]

    def clear(self) -> None:
        self.held.clear()
        self.hits = self.misses = 0


def candidate_paths(index: PathIndex, k: int, max_deviations: int | None = None) -> DataFrame:
    """cost, source, last, level, devs of all paths that cost no more than the K-th, ties included.

    A path is its source and its deviations; each round adds one deviation to the paths that the
    last one found, where the cost stays within the K-th smallest seen so far. Costs never fall
    along the way, so nothing that is pruned could lead to a wanted path.
    """
    if k <= 0:
        raise ValueError("k is at least 1")
    spark = index.edges.sparkSession
    scratch = Scratch(spark, "topk")
    empty = F.array().cast("array<struct<u:bigint,v:bigint>>")
    front = scratch.save(index.roots.select(F.col("dist").alias("cost"), F.col("id").alias("source"), F.col("id").alias("last"), F.lit(0).alias("level"), empty.alias("devs")), "f0")
    files, level, theta = [scratch.path("f0")], 0, None
    devs = index.devs.select(F.col("src").alias("u"), F.col("dst").alias("v"), "delta")

    def kept() -> DataFrame:
        whole = spark.read.schema(front.schema).parquet(*files)
        return whole if theta is None else whole.where(F.col("cost") <= theta)

    def bound(costs: DataFrame) -> int | None:
        got = costs.orderBy("cost").limit(k).agg(F.max("cost").alias("m"), F.count("*").alias("n")).first()
        return got["m"] if got["n"] == k else None

    theta = bound(kept().select("cost"))
    while max_deviations is None or level < max_deviations:
        level += 1
        chains = index.chains(front.select(F.col("last").alias("id")).distinct()).select(F.col("id").alias("last"), "u")
        step = front.join(chains, "last").join(devs, "u").withColumn("total", F.col("cost") + F.col("delta"))
        if theta is None:  # with no bound yet, the K least of what is known and what comes give one, and nothing beyond it is written
            theta = bound(kept().select("cost").unionByName(step.select(F.col("total").alias("cost"))))
        if theta is not None:
            step = step.where(F.col("total") <= theta)
        grown = F.concat("devs", F.array(F.struct("u", "v")))
        step = step.select(F.col("total").alias("cost"), "source", F.col("v").alias("last"), F.lit(level).alias("level"), grown.alias("devs"))
        step, n = scratch.save_counted(step, f"f{level}", F.count(F.lit(1)))
        if not n:
            break
        files.append(scratch.path(f"f{level}"))
        theta = bound(kept().select("cost"))
        front = step if theta is None else step.where(F.col("cost") <= theta)
    return kept()


def with_vertices(paths: DataFrame, index: PathIndex) -> DataFrame:
    """``paths`` with ``path``, the vertices in order."""
    paths = Scratch(index.edges.sparkSession, "named").save(paths, "paths")
    ends = paths.select(F.explode(F.concat(F.array("source"), "devs.v")).alias("id")).distinct()
    arrays = chain_arrays(index.chains(ends))
    seg = F.expr("transform(sequence(0, size(devs)), i -> struct(i as i, if(i = 0, source, devs[i - 1].v) as start, if(i = size(devs), null, devs[i].u) as stop))")
    parts = paths.withColumn("key", F.struct("source", "devs")).select("key", "cost", "level", F.explode(seg).alias("s")).select("key", "cost", "level", "s.*")
    parts = parts.join(arrays.withColumnRenamed("id", "start"), "start")
    piece = F.expr("if(stop is null, way, slice(way, 1, cast(array_position(way, stop) as int)))")
    joined = parts.groupBy("key", "cost", "level").agg(F.sort_array(F.collect_list(F.struct("i", piece.alias("p")))).alias("ps"))
    return joined.select("cost", "level", F.col("key.source").alias("source"), F.col("key.devs").alias("devs"), F.flatten(F.transform("ps", lambda x: x["p"])).alias("path"))


def _named(paths: DataFrame, index: PathIndex) -> DataFrame:
    return with_vertices(paths, index).withColumn("name", F.array_join(F.transform("path", lambda v: v.cast("string")), "-"))


def topk_costs(index: PathIndex, k: int, max_deviations: int | None = None) -> DataFrame:
    """rank (from 1), cost of the K cheapest paths."""
    first = candidate_paths(index, k, max_deviations).select("cost").orderBy("cost").limit(k)
    return first.select(F.row_number().over(Window.orderBy("cost")).cast("long").alias("rank"), "cost")  # k rows


def topk_paths(index: PathIndex, k: int, max_deviations: int | None = None) -> DataFrame:
    """rank, cost, level, path (vertices joined by '-'); ties go by the path's name."""
    first = _named(candidate_paths(index, k, max_deviations), index).orderBy("cost", "name").limit(k)
    return first.select(F.row_number().over(Window.orderBy("cost", "name")).cast("long").alias("rank"), "cost", "level", F.col("name").alias("path"))  # k rows


def topk_with_ties(index: PathIndex, k: int) -> DataFrame:
    """cost, path of every path that costs no more than the K-th."""
    return _named(candidate_paths(index, k), index).select("cost", F.col("name").alias("path"))


def path_nodes(index: PathIndex, k: int, max_deviations: int | None = None) -> DataFrame:
    """node_id, level, from, to, parent, n_children, slack of the K first path nodes, and parents among them.

    Numbers are ranks by (cost, source, deviations); a parent costs no more than its child and has
    a shorter list, so it comes first.
    """
    paths = candidate_paths(index, k, max_deviations).withColumn("key", F.to_json(F.struct("source", "devs")))
    rank = F.row_number().over(Window.orderBy("cost", "level", "key")) - 1
    first = paths.orderBy("cost", "level", "key").limit(k).withColumn("node_id", rank.cast("long"))
    first = Scratch(index.edges.sparkSession, "nodes").save(first, "first")
    up = F.to_json(F.struct("source", F.expr("slice(devs, 1, greatest(size(devs) - 1, 0))").alias("devs")))
    linked = first.withColumn("up", F.when(F.col("level") > 0, up)).join(first.select(F.col("key").alias("up"), F.col("node_id").alias("parent")), "up", "left")
    children = linked.where("parent is not null").groupBy(F.col("parent").alias("node_id")).agg(F.count("*").alias("n_children"))
    at = F.when(F.col("level") > 0, F.element_at("devs", -1)["u"]).otherwise(-1)
    return linked.join(children, "node_id", "left").select(
        "node_id", F.col("level").cast("long").alias("level"), at.cast("long").alias("from_v"), F.col("last").alias("to_v"),
        F.coalesce("parent", F.lit(-1)).alias("parent"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("cost").alias("slack"),
    )
