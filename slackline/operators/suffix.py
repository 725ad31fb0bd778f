"""Suffix distances, successors and deviations of a DAG."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.functions.candidates import delta
from slackline.operators.graph import degrees
from slackline.plans.scratch import Scratch


class CycleError(ValueError):
    pass


#: Edges from which on a table without those that are done is worth its writing.
MANY = 10_000_000


def suffix_tree(edges: DataFrame, vertices: DataFrame | None = None, scratch: Scratch | None = None, degree: DataFrame | None = None) -> DataFrame:
    """id, level, dist, succ: topological level from the sinks, cheapest cost to a sink, and the next vertex on that way.

    A round joins the vertices found last with the edges that lead to them. A vertex carries the
    number of its edges met so far and the best of them; it is found in the round in which that
    number is its out-degree, which is its level, so each edge is relaxed once, in topological
    order. What a round writes is vertices that it met or that wait, never edges; those are written
    anew only when half of them are done. Ties go to the least head. Sinks have distance 0 and no
    successor. ``degree`` is a written table of ``degrees``. Raises CycleError.
    """
    scratch = scratch or Scratch(edges.sparkSession, "suffix")
    spark = edges.sparkSession
    degree = scratch.save(degrees(edges, vertices), "degrees") if degree is None else degree
    start = degree.where("out_degree = 0")
    now = start.select("id", F.lit(0).alias("level"), F.struct(F.lit(0).cast("long").alias("dist"), F.lit(None).cast("long").alias("succ")).alias("best"), F.lit(0).cast("long").alias("met"), F.lit(True).alias("found"))
    now, n_sinks = scratch.save_counted(now, "round0", F.count(F.lit(1)))
    sizes = degree.agg(F.count("*").alias("v"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("e")).first()
    degree = degree.select("id", "out_degree")
    n_inner, left, filled, written, level = sizes["v"] - n_sinks, edges, 0, sizes["e"], 0
    best = F.min("best").alias("best")
    while True:
        level += 1
        front = now.where("found").select(F.col("id").alias("dst"), "best.dist")
        met = left.join(front, "dst").groupBy(F.col("src").alias("id")).agg(F.min(F.struct((F.col("w") + F.col("dist")).alias("dist"), F.col("dst").alias("succ"))).alias("best"), F.count("*").alias("met"))
        waiting = now.where("not found").select("id", "best", "met")
        both = met.unionByName(waiting).groupBy("id").agg(best, F.sum("met").alias("met"))
        both = both.join(degree, "id").select("id", F.lit(level).alias("level"), "best", "met", (F.col("met") == F.col("out_degree")).alias("found"))
        told = F.struct(F.count_if("found").alias("n"), F.coalesce(F.sum(F.when(F.col("found"), F.col("met"))), F.lit(0)).alias("edges"))
        now, got = scratch.save_counted(both, f"round{level}", told)
        n_inner -= got["n"]
        filled += got["edges"]
        if not got["n"]:
            break
        if not n_inner:
            level += 1
            break
        if 2 * filled > written > MANY:  # edges out of vertices that are found are of no more use
            done = spark.read.schema(now.schema).parquet(*(scratch.path(f"round{k}") for k in range(1, level + 1))).where("found")
            left, written, filled = scratch.save(left.join(done.select(F.col("id").alias("src")), "src", "left_anti"), f"left{level}"), written - filled, 0
    if n_inner:
        raise CycleError("the graph has a cycle")
    whole = spark.read.schema(now.schema).parquet(*(scratch.path(f"round{k}") for k in range(level)))
    return whole.where("found").select("id", "level", "best.dist", "best.succ")


def deviations(edges: DataFrame, tree: DataFrame, only_reachable: bool = True) -> DataFrame:
    """src, dst, w, delta, reachable of every edge that leaves the suffix tree."""
    a = tree.select(F.col("id").alias("src"), F.col("dist").alias("ds"), "succ")
    b = tree.select(F.col("id").alias("dst"), F.col("dist").alias("dd"))
    devs = edges.join(a, "src", "left").join(b, "dst", "left").where(~F.col("dst").eqNullSafe(F.col("succ")))
    known = F.col("ds").isNotNull() & F.col("dd").isNotNull()
    devs = devs.select("src", "dst", "w", F.coalesce(delta(F.col("ds"), F.col("dd"), F.col("w")), F.lit(0)).alias("delta"), known.alias("reachable"))
    return devs.where("reachable") if only_reachable else devs


def successor_jumps(tree: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables (id, to) of the vertices 1, 2, 4, ... steps on, as long as any way goes so far: a row per vertex and table."""
    jump, out = scratch.save(tree.where("succ is not null").select("id", F.col("succ").alias("to")), "jump0"), []
    while not jump.isEmpty():
        out.append(jump)
        jump = scratch.save(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), f"jump{len(out)}")
    return out


def suffix_chains(ids: DataFrame, jumps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """id, u, pos: every vertex on the ways of ``ids(id)`` to a sink, in log2(depth) joins. Each doubles the plan, so every third is written."""
    chains = ids.select("id", F.col("id").alias("u"), F.lit(0).alias("pos"))
    tag = uuid.uuid4().hex[:8]
    for k, jump in enumerate(jumps):
        if k % 3 == 0 and (k or len(jumps) > 1):
            chains = scratch.save(chains, f"chain_{tag}_{k}")
        more = chains.join(jump.select(F.col("id").alias("u"), "to"), "u").select("id", F.col("to").alias("u"), (F.col("pos") + 2**k).alias("pos"))
        chains = chains.unionByName(more)
    return chains


def chain_arrays(chains: DataFrame) -> DataFrame:
    """id, way: the vertices from id to its sink, in order."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "u")))
    return chains.groupBy("id").agg(F.transform(ordered, lambda x: x["u"]).alias("way"))


def violated(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Edges that break dist(src) <= w + dist(dst), or don't go down in level; empty if all is well."""
    a = tree.select(F.col("id").alias("src"), F.col("dist").alias("ds"), F.col("level").alias("ls"))
    b = tree.select(F.col("id").alias("dst"), F.col("dist").alias("dd"), F.col("level").alias("ld"))
    return edges.join(a, "src").join(b, "dst").where("ds > w + dd or ls <= ld").select("src", "dst", "w")
