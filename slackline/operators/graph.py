"""Graphs as ``edges(src, dst, w)``: structure, levels, relabelling and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackline.plans.scratch import Scratch


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst), of least weight; deviations compare vertices, so this is needed for exact paths."""
    return edges.groupBy("src", "dst").agg(F.min("w").alias("w"))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def sources(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    vertices = vertices_of(edges) if vertices is None else vertices.select("id")
    return vertices.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def sinks(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    vertices = vertices_of(edges) if vertices is None else vertices.select("id")
    return vertices.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, out_degree, in_degree, in one shuffle; vertices without edges only if they are given."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    if vertices is not None:
        ends = ends.union(vertices.select(F.col("id").cast("long"), F.lit(0), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def degree_extremes(edges: DataFrame) -> DataFrame:
    """max_out_degree, max_in_degree in one row."""
    return degrees(edges).agg(F.max("out_degree").alias("max_out_degree"), F.max("in_degree").alias("max_in_degree"))


def graph_stats(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """n_vertices, n_edges, avg_degree (4 decimals), diameter (largest topological level)."""
    v = levels.agg(F.count("*").alias("n_vertices"), F.max("level").alias("diameter"))
    e = edges.agg(F.count("*").alias("n_edges"))
    both = v.withColumn("k", F.lit(0)).join(e.withColumn("k", F.lit(0)), "k")
    return both.select("n_vertices", "n_edges", F.round(F.col("n_edges") / F.col("n_vertices"), 4).alias("avg_degree"), "diameter")


def bfs_levels(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, level: fewest edges to a sink, -1 for a vertex that reaches none. Not a schedule for relaxation: edges may skip levels."""
    spark = edges.sparkSession
    scratch = Scratch(spark, "bfs")
    every, left = scratch.save_counted(degrees(edges, vertices), "degrees", F.count(F.lit(1)))
    front, n = scratch.save_counted(every.where("out_degree = 0").select("id", F.lit(0).alias("level")), "l0", F.count(F.lit(1)))
    paths, level = [scratch.path("l0")], 0
    read = lambda: spark.read.schema(front.schema).parquet(*paths)  # noqa: E731  one scan, however many levels
    while n and (left := left - n):
        level += 1
        near = edges.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        front, n = scratch.save_counted(near.join(read().select("id"), "id", "left_anti").withColumn("level", F.lit(level)), f"l{level}", F.count(F.lit(1)))
        paths.append(scratch.path(f"l{level}"))
    if not left:
        return read()
    return read().unionByName(every.join(read().select("id"), "id", "left_anti").select("id", F.lit(-1).alias("level")))


def level_histogram(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level").agg(F.count("*").alias("n"))


def level_pointers(levels: DataFrame) -> DataFrame:
    """level, first: how many vertices lie on lower levels. A row per level, so one window partition is small."""
    from pyspark.sql import Window

    before = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return level_histogram(levels).select("level", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def level_spans(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """span, n: how many edges go down so many levels."""
    a = levels.select(F.col("id").alias("src"), F.col("level").alias("ls"))
    b = levels.select(F.col("id").alias("dst"), F.col("level").alias("ld"))
    return edges.join(a, "src").join(b, "dst").groupBy((F.col("ls") - F.col("ld")).alias("span")).agg(F.count("*").alias("n"))


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ``mapping(id, new_id)``; an end that is not mapped fails the job."""
    a = mapping.select(F.col("id").alias("src"), F.col("new_id").alias("s"))
    b = mapping.select(F.col("id").alias("dst"), F.col("new_id").alias("d"))
    must = lambda c, of: F.coalesce(c, F.raise_error(F.format_string("vertex %d is not mapped", of)).cast("long"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    return both.select(must(F.col("s"), F.col("src")).alias("src"), must(F.col("d"), F.col("dst")).alias("dst"), "w")


#: Ids that one task ranks at a time.
RANGE = 65_536


def _before(rows: DataFrame, group: list[str], width: int, n: Column, name: str) -> DataFrame:
    """group, range, ``name``: the sum of ``n`` over the ranges of ids in front; a row per group and range."""
    from pyspark.sql import Window

    sums = rows.groupBy(*group, F.floor(F.col("id") / width).alias("range")).agg(n.alias("n"))
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))


def ranked(rows: DataFrame, group: str, width: int = RANGE) -> DataFrame:
    """``rows(id, group, ...)`` with ``k``: the place of the id inside its group, from 0.

    Ranks come from counts by range of ids and from places inside a range, so no group is sorted
    in one task, however many vertices it has. Ids are distinct.
    """
    from pyspark.sql import Window

    base = _before(rows, [group], width, F.count("*"), "base")
    within = F.row_number().over(Window.partitionBy(group, "range").orderBy("id")) - 1
    placed = rows.withColumn("range", F.floor(F.col("id") / width)).withColumn("at", within).join(base, [group, "range"])
    return placed.withColumn("k", (F.col("base") + F.col("at")).cast("long")).drop("range", "at", "base")


def order_by_level(levels: DataFrame) -> DataFrame:
    """id, new_id: dense numbers by (level, id); ranks inside a level, level pointers in front."""
    return ranked(levels, "level").join(level_pointers(levels), "level").select("id", (F.col("first") + F.col("k")).cast("long").alias("new_id"))


def row_offsets(edges: DataFrame, vertices: DataFrame | None = None, width: int = RANGE) -> DataFrame:
    """id, first, n: where each vertex's edges begin in an edge list sorted by source, and how many there are."""
    from pyspark.sql import Window

    vertices = vertices_of(edges) if vertices is None else vertices.select("id")
    n = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    rows = vertices.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    base = _before(rows, [], width, F.sum("n"), "base")
    front = Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("range", F.floor(F.col("id") / width)).withColumn("at", F.coalesce(F.sum("n").over(front), F.lit(0)))
    return placed.join(base, "range").select("id", (F.col("base") + F.col("at")).alias("first"), "n")


def sized_up(edges: DataFrame, times: int, stride: int) -> DataFrame:
    """``times`` disjoint copies, ids moved by multiples of ``stride``."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("copy")
    return edges.select("*", copy).select((F.col("src") + F.col("copy") * stride).alias("src"), (F.col("dst") + F.col("copy") * stride).alias("dst"), "w")


def with_weights(edges: DataFrame, seed: int = 1, unit: int | None = None, most: int = 100_000) -> DataFrame:
    """Repeatable pseudo-random weights from 1 to ``most``, or ``unit`` for every edge."""
    w = F.lit(unit) if unit is not None else F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(most)) + 1
    return edges.select("src", "dst", w.cast("long").alias("w"))


def densified(edges: DataFrame, levels: DataFrame, degree: float, seed: int = 1) -> DataFrame:
    """Edges added between adjacent levels, repeatably, up to ``degree`` edges a vertex on average."""
    n, m = levels.count(), edges.count()
    want = max(0, int(degree * n) - m)
    if not want or not n:
        return edges
    each = -(-2 * want // n)
    slots = ranked(levels, "level").withColumnRenamed("k", "slot")
    sizes = level_histogram(levels).select((F.col("level") + 1).alias("level"), F.col("n").alias("below"))
    draws = levels.join(sizes, "level").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(each))))
    draws = draws.withColumn("slot", F.pmod(F.xxhash64("id", "k", F.lit(seed)), F.col("below"))).withColumn("level", F.col("level") - 1)
    new = draws.join(slots.select("level", "slot", F.col("id").alias("dst")), ["level", "slot"]).select(F.col("id").alias("src"), "dst").distinct()
    new = new.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    new = Scratch(edges.sparkSession, "densify").save(new.withColumn("h", F.xxhash64("src", "dst", F.lit(seed))), "new")
    return edges.unionByName(with_weights(_first_by_hash(new, want), seed))


def _first_by_hash(rows: DataFrame, n: int, ranges: int = RANGE) -> DataFrame:
    """The n first of ``rows(src, dst, h)`` by hash: whole ranges of hashes, and of the next range its first."""
    from pyspark.sql import Window

    rows = rows.withColumn("range", F.expr(f"shiftright(h, {65 - ranges.bit_length()})"))
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))  # at most `ranges` rows
    ends = counts.withColumn("end", F.sum("n").over(Window.orderBy("range")))
    cut = ends.where(F.col("end") >= n).orderBy("range").first()
    if cut is None:
        return rows.select("src", "dst")
    rest = n - (cut["end"] - cut["n"])
    edge = rows.where(F.col("range") == cut["range"]).orderBy("h", "src", "dst").limit(rest)
    return rows.where(F.col("range") < cut["range"]).unionByName(edge).select("src", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """src, neighbours: array of (dst, w) by dst; the row form of a compressed sparse matrix. A row holds all edges of a vertex; ``sorted_edges`` has no such rows."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("neighbours"))


def sorted_edges(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """src, k, dst, w: edges numbered from 0 within their source, by head; with ``row_offsets`` a compressed sparse matrix of rows of any length."""
    return ranked(edges.withColumnRenamed("dst", "id"), "src").select("src", "k", F.col("id").alias("dst"), "w")
