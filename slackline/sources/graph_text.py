"""Text forms of graphs and of what is computed on them.

A graph file has the vertex count on its first line, then a quoted name per vertex, then
``"u" -> "v"`` per edge, with ``, weight`` if it has one. Semicolons at the end of a line and white
space around the parts may be there or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.functions.candidates import SCALE, scaled
from slackline.operators.graph import level_pointers, row_offsets, sorted_edges

_EDGE = r'^\s*"(\d+)"\s*->\s*"(\d+)"\s*(?:,\s*([-+0-9.eE]+))?\s*;?\s*$'
_VERTEX = r'^\s*"[^"]*"\s*;?\s*$'
_COUNT = r"^\s*\d+\s*$"


class GraphFormatError(ValueError):
    pass


def read_graph(spark: SparkSession, path: str, default_weight: float = 0.0, ignore_weights: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices(id) and edges(src, dst, w), parallels kept, weights in scaled units.

    An edge without a weight gets ``default_weight``; with ``ignore_weights`` every edge does.
    Raises GraphFormatError if a line can't be read, if the stated count isn't that of the vertex
    lines, or if an end lies outside it.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    # The count is the only line of digits alone; names and edges are quoted.
    edge, vertex, count = (F.col("value").rlike(x) for x in (_EDGE, _VERTEX, _COUNT))
    told = lines.agg(F.count_if(vertex).alias("vertices"), F.count_if(count).alias("counts"), F.max(F.when(count, F.trim("value").cast("long"))).alias("n")).first()
    if told["counts"] != 1:
        raise GraphFormatError("the vertex count is missing or given twice")
    n = told["n"]
    if told["vertices"] != n:
        raise GraphFormatError(f"{n} vertices are stated and {told['vertices']} named")
    weight = F.regexp_extract("value", _EDGE, 3)
    given = F.lit(default_weight) if ignore_weights else F.when(weight == "", F.lit(default_weight)).otherwise(weight.try_cast("double"))
    edges = lines.where(edge).select(F.regexp_extract("value", _EDGE, 1).cast("long").alias("src"), F.regexp_extract("value", _EDGE, 2).cast("long").alias("dst"), scaled(given).alias("w"))
    bad = lines.where(~edge & ~vertex & ~count).select("value").union(out_of_range(edges, n).select(F.to_json(F.struct("src", "dst")))).first()
    if bad:
        raise GraphFormatError(f"can't use {bad[0]!r} in a graph of {n} vertices")
    return spark.range(n), edges


def out_of_range(edges: DataFrame, n: int) -> DataFrame:
    return edges.where((F.col("src") < 0) | (F.col("dst") < 0) | (F.col("src") >= n) | (F.col("dst") >= n) | F.col("w").isNull())


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """The text form as one sorted sequence of part files: count, names, edges."""
    n = vertices.count()
    spark = vertices.sparkSession
    weight = F.format_string("%.4f", F.col("w") / SCALE)
    rows = (
        spark.createDataFrame([(0, -1, -1, str(n))], "kind int, a long, b long, value string")
        .union(vertices.select(F.lit(1), F.col("id"), F.lit(-1).cast("long"), F.format_string('"%d";', "id")))
        .union(edges.select(F.lit(2), "src", "dst", F.concat(F.format_string('"%d" -> "%d", ', "src", "dst"), weight, F.lit(";"))))
    )
    rows.orderBy("kind", "a", "b").select("value").write.mode("overwrite").text(path)


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``k``, their number from 0 over all files in order of name; counted by part of a file, so none is read in one task."""
    from pyspark.sql import Window

    parts = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n"))  # a row per part
    base = sizes.select(F.col("file").alias("f"), F.col("start").alias("s"), F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("file", "start").orderBy("at")) - 1
    placed = lines.withColumn("k", within).join(base, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    return placed.select("value", (F.col("base") + F.col("k")).alias("k"))


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of an adjacency-list file: a header, then line k names the neighbours of vertex k (from 1).

    The header is vertices, edges, and perhaps a format of three digits (vertex sizes, vertex
    weights, edge weights are given) and a number of weights a vertex; what isn't a neighbour is
    passed over. Edges point from the lesser id to the greater, so there is no cycle. Raises
    GraphFormatError on a header that can't be read, too many lines or a neighbour that isn't there.
    """
    numbered = _numbered(_read_lines(spark, path).where(~F.col("value").startswith("%")))
    head = numbered.where("k = 0").first()
    told = head["value"].split() if head else []
    if not 2 <= len(told) <= 4 or not all(x.isdigit() for x in told):
        raise GraphFormatError("the header doesn't give vertices and edges")
    n, form = int(told[0]), told[2].zfill(3) if len(told) > 2 else "000"
    weights = (int(told[3]) if len(told) > 3 else 1) if form[1] == "1" else 0
    fields = F.expr(r"filter(split(trim(value), '\\s+'), x -> x <> '')")
    near = numbered.where("k > 0").select("k", F.slice(fields, 1 + weights + (form[0] == "1"), 2**30).alias("x"))
    if form[2] == "1":
        near = near.select("k", F.filter("x", lambda _, i: i % 2 == 0).alias("x"))
    pairs = near.select((F.col("k") - 1).alias("a"), F.explode("x").alias("b")).select("a", (F.col("b").try_cast("long") - 1).alias("b"))
    bad = pairs.where(F.col("b").isNull() | (F.col("b") < 0) | (F.col("b") >= n) | (F.col("a") >= n)).first()
    if bad:
        raise GraphFormatError(f"vertex {bad['a'] + 1} of {n} has a neighbour that can't be used")
    return pairs.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def read_timing_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices(id, name) and edges(src, dst, w) of ``insert_edge SRC DST`` lines with eight delays, each a number or n/a.

    The weight is the least delay; parallels collapse to the least; ids follow first appearance.
    Comments and other operations are skipped. Raises GraphFormatError on a wrong number of fields,
    an unreadable delay or an edge without any.
    """
    from pyspark.sql import Window

    lines = _numbered(_read_lines(spark, path)).withColumnRenamed("k", "at").withColumn("f", F.split(F.trim("value"), r"\s+")).where(F.col("f")[0] == "insert_edge")
    times = F.transform(F.filter(F.slice("f", 4, 99), lambda x: x != "n/a"), lambda x: x.try_cast("double"))
    rows = lines.select("value", "at", F.size("f").alias("n"), F.col("f")[1].alias("a"), F.col("f")[2].alias("b"), times.alias("t"))
    bad = rows.where((F.col("n") != 11) | (F.size("t") == 0) | F.exists("t", lambda x: x.isNull())).first()
    if bad:
        raise GraphFormatError(f"can't read {bad['value']!r}")
    rows = rows.select("at", "a", "b", scaled(F.array_min("t")).alias("w"))
    seen = rows.select(F.col("a").alias("name"), (F.col("at") * 2).alias("p")).union(rows.select("b", F.col("at") * 2 + 1)).groupBy("name").agg(F.min("p").alias("p"))
    buckets = seen.withColumn("bucket", F.floor(F.col("p") / 65536))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("p")) - 1
    vertices = buckets.withColumn("k", within).join(base.select("bucket", "base"), "bucket").select((F.col("base") + F.col("k")).cast("long").alias("id"), "name")
    a, b = vertices.select(F.col("id").alias("src"), F.col("name").alias("a")), vertices.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return vertices, rows.groupBy("a", "b").agg(F.min("w").alias("w")).join(a, "a").join(b, "b").select("src", "dst", "w")


def dumps(edges: DataFrame, tree: DataFrame) -> dict[str, DataFrame]:
    """The tables that other tools read, by name; distances with four decimals."""
    decimals = lambda c: F.format_string("%.4f", F.col(c) / SCALE)
    return {
        "edge_list": edges.select("src", "dst"),
        "edge_list_weighted": edges.select("src", "dst", decimals("w").alias("weight")),
        "edges_transformed": edges.select("src", "dst", F.col("w").alias("weight")),
        "suffix": tree.select("id", decimals("dist").alias("dist")),
        "successors": tree.select("id", F.coalesce("succ", F.lit(-1)).alias("succ"), "dist"),
        "levels": tree.select("id", "level"),
        "level_order": tree.orderBy("level", "id").select("id"),
        "dists_in_level_order": tree.orderBy("level", "id").select(decimals("dist").alias("dist")),
        "level_sizes": level_pointers(tree.select("id", "level")),
    }


def write_dump(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep=" ")


def write_dumps(edges: DataFrame, tree: DataFrame, folder: str) -> None:
    """Every table of ``dumps`` in a folder of its name."""
    for name, df in dumps(edges, tree).items():
        write_dump(df, f"{folder}/{name}")


def write_csr(edges: DataFrame, vertices: DataFrame, folder: str) -> None:
    """A compressed sparse matrix as tables: offsets(id, first, n) and targets(src, k, dst, w)."""
    row_offsets(edges, vertices).write.mode("overwrite").parquet(f"{folder}/offsets")
    sorted_edges(edges).write.mode("overwrite").parquet(f"{folder}/targets")


def read_csr(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """vertices(id) and edges(src, dst, w); ValueError unless rows are as long as the offsets say."""
    offsets, targets = spark.read.parquet(f"{folder}/offsets"), spark.read.parquet(f"{folder}/targets")
    held = targets.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("m"), F.max("k").alias("last"))
    wrong = offsets.where("n > 0").join(held, "id", "full").where("n IS NULL OR m IS NULL OR n <> m OR last <> n - 1").first()
    if wrong:
        raise ValueError(f"the row of vertex {wrong['id']} is not as long as its offset says")
    return offsets.select("id"), targets.select("src", "dst", "w")


def read_successors(spark: SparkSession, path: str) -> DataFrame:
    """id, succ (null at sinks), dist of a successor dump; ValueError if a vertex comes twice."""
    rows = spark.read.csv(path, sep=" ", schema="id long, succ long, dist long")
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"vertex {twice['id']} comes {twice['n']} times")
    return rows.select("id", F.when(F.col("succ") >= 0, F.col("succ")).alias("succ"), "dist")


def base_name(path: Column) -> Column:
    """The last part of a path, without what stands behind its first point."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*/?$", 1)


def load_dumps(spark: SparkSession, suffix: str, edges: str, levels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """suffix(id, dist), edges(src, dst, w), levels(id, level) in scaled units; ValueError unless levels cover the vertices."""
    read = lambda p, s: spark.read.csv(p, sep=" ", schema=s)
    dist = read(suffix, "id long, dist double").select("id", scaled(F.col("dist")).alias("dist"))
    edge = read(edges, "src long, dst long, w double").select("src", "dst", scaled(F.col("w")).alias("w"))
    level = read(levels, "id long, level int")
    n, m = dist.count(), level.count()
    if n != m or not dist.join(level, "id", "left_anti").isEmpty():
        raise ValueError(f"the level table names {m} vertices, the distance table {n}, or others")
    return dist, edge, level


def write_costs(costs: DataFrame, path: str) -> None:
    """One cost a line, ascending (the K cheapest: K rows)."""
    costs.orderBy("rank").select(F.format_string("%.4f", F.col("cost") / SCALE).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """rank, cost of a cost list (K rows)."""
    from pyspark.sql import Window

    rows = spark.read.text(path).select(scaled(F.trim("value")).alias("cost"))
    return rows.select(F.row_number().over(Window.orderBy("cost")).cast("long").alias("rank"), "cost")


def read_vertex_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="id long, new_id long")


def read_hops(spark: SparkSession, path: str) -> DataFrame:
    """src, succ, cost; ValueError if a source has two successors."""
    from slackline.operators.metrics import conflicting_successors

    hops = spark.read.csv(path, sep=" ", schema="src long, succ long, cost double").select("src", "succ", scaled(F.col("cost")).alias("cost"))
    bad = conflicting_successors(hops).first()
    if bad:
        raise ValueError(f"vertex {bad['src']} has {bad['n']} successors")
    return hops


CAPTURE_VERSION = 2


def write_capture(parents: DataFrame, families: DataFrame, path: str) -> None:
    """Parents and families as a snapshot, with its version."""
    spark = parents.sparkSession
    parents.write.mode("overwrite").parquet(f"{path}/parents")
    families.write.mode("overwrite").parquet(f"{path}/families")
    spark.createDataFrame([("slackline-capture", CAPTURE_VERSION)], "kind string, version int").write.mode("overwrite").parquet(f"{path}/about")


def read_capture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    about = spark.read.parquet(f"{path}/about").first()
    if about["kind"] != "slackline-capture" or about["version"] != CAPTURE_VERSION:
        raise ValueError(f"not a capture of version {CAPTURE_VERSION}")
    parents, families = spark.read.parquet(f"{path}/parents"), spark.read.parquet(f"{path}/families")
    if not families.where("src < 0 or dst < 0").isEmpty() or not parents.where("src < 0").isEmpty():
        raise ValueError("a vertex id is negative")
    return parents, families


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, header=True)
