"""Errors against a golden list, windows of cost, timings, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cost_error(golden: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """avg_error_pct (over k), max_error_pct of two lists (rank, cost); golden costs of 0 or less don't count."""
    both = golden.select("rank", F.col("cost").alias("g")).join(own.select("rank", F.col("cost").alias("c")), "rank").where("g > 0")
    error = F.abs(F.col("c") - F.col("g")) / F.col("g") * 100
    return both.agg(F.round(F.coalesce(F.sum(error), F.lit(0.0)) / k, 6).alias("avg_error_pct"), F.round(F.coalesce(F.max(error), F.lit(0.0)), 6).alias("max_error_pct"))


def compare_prefix(golden: DataFrame, own: DataFrame, k: int, tolerance: int = 10) -> DataFrame:
    """max_diff, max_rank, first_mismatch (rank or null), passed over the first k ranks."""
    both = golden.where(F.col("rank") <= k).select("rank", F.col("cost").alias("g")).join(own.select("rank", F.col("cost").alias("c")), "rank", "full").where(F.col("rank") <= k)
    off = F.coalesce(F.abs(F.col("g") - F.col("c")), F.lit(2**62))
    got = both.agg(F.max(off).alias("max_diff"), F.max_by("rank", F.struct(off, -F.col("rank"))).alias("max_rank"), F.min(F.when(off > tolerance, F.col("rank"))).alias("first_mismatch"))
    return got.withColumn("passed", F.col("first_mismatch").isNull())


def paths_per_step(costs: DataFrame, width: int) -> DataFrame:
    """step, n, total: paths by cost window of ``width`` from the cheapest on, and the running sum; a row per step."""
    low = costs.agg(F.min("cost")).scalar()
    steps = costs.groupBy(F.floor((F.col("cost") - low) / width).cast("long").alias("step")).agg(F.count("*").alias("n"))
    return steps.withColumn("total", F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))


def timing_summary(runs: DataFrame) -> DataFrame:
    """name, mean, least, most, median of ``runs(name, ms)``."""
    return runs.groupBy("name").agg(F.avg("ms").alias("mean"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.median("ms").alias("median"))


def unvisited(depths: DataFrame) -> DataFrame:
    """n: how many depths are -1."""
    return depths.agg(F.count_if(F.col("depth") == -1).alias("n"))


def csr_violations(offsets: DataFrame, targets: DataFrame) -> DataFrame:
    """problem, n of a compressed sparse matrix ``offsets(k, at)``, ``targets(k, id)``: what is not monotone, out of range or of wrong size."""
    rows = offsets.count() - 1
    after = offsets.select((F.col("k") - 1).alias("k"), F.col("at").alias("after"))
    falling = offsets.join(after, "k").where("after < at").select(F.lit("falling").alias("problem"))
    strange = targets.where((F.col("id") < 0) | (F.col("id") >= rows)).select(F.lit("out_of_range").alias("problem"))
    ends = offsets.agg(F.min_by("at", "k").alias("lo"), F.max_by("at", "k").alias("hi"))
    size = targets.agg(F.count("*").alias("m"))
    wrong = ends.withColumn("j", F.lit(0)).join(size.withColumn("j", F.lit(0)), "j").where("lo <> 0 or hi <> m").select(F.lit("size").alias("problem"))
    return falling.union(strange).union(wrong).groupBy("problem").agg(F.count("*").alias("n"))


def gate(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """n_vertices, n_edges and counts of what a suffix tree must not have, in one row.

    ``bad_sinks``: no successor, yet a distance or level other than 0; ``bad_levels``: edges that
    don't go down; ``not_least``: edges that would shorten a way; ``bad_successors``: distances
    that the edge to the successor doesn't give.
    """
    a = tree.select(F.col("id").alias("src"), F.col("dist").alias("ds"), F.col("level").alias("ls"), "succ")
    b = tree.select(F.col("id").alias("dst"), F.col("dist").alias("dd"), F.col("level").alias("ld"))
    e = edges.join(a, "src").join(b, "dst").agg(
        F.count("*").alias("n_edges"), F.count_if(F.col("ls") <= F.col("ld")).alias("bad_levels"), F.count_if(F.expr("ds > w + dd")).alias("not_least"),
        F.count_if(F.expr("dst <=> succ AND ds <> w + dd")).alias("bad_successors"),
    )
    v = tree.agg(F.count("*").alias("n_vertices"), F.count_if(F.expr("succ IS NULL AND (dist <> 0 OR level <> 0)")).alias("bad_sinks"))
    return v.withColumn("j", F.lit(0)).join(e.withColumn("j", F.lit(0)), "j").drop("j")


def conflicting_successors(hops: DataFrame) -> DataFrame:
    """src with more than one successor in ``hops(src, succ)``."""
    return hops.groupBy("src").agg(F.count_distinct("succ").alias("n")).where("n > 1")


def parse_k_list(text: str) -> list[int]:
    """Positive whole numbers between commas; ValueError on anything else or on none."""
    found = [int(x) for x in text.split(",")] if text.strip() else []
    if not found or min(found) <= 0:
        raise ValueError(f"not a list of positive numbers: {text!r}")
    return found
