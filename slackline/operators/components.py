"""Connected components of an undirected graph, by contraction towards random minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.plans.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``edges(a, b)`` to ``(id, component)``, one row per node that has an edge.

    ``component`` is one of the members, the same for all of them (not always the smallest).
    Each round every node takes the neighbour, or itself, of least salted hash as its parent; the
    edges are relabelled by parents, loops and repeats dropped. The hash order differs by round,
    so a chain of ascending ids contracts as fast as any other. Minima are pre-aggregated before
    the shuffle, and relabelling joins read written tables, so a hub is split by AQE. Self-loops
    give a component of one; null ends are dropped; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null")
    kind = edges.schema["a"].dataType
    level, levels = 0, []
    now = scratch.save(edges.select("a", "b").distinct(), f"{tag}_e0")
    while not now.isEmpty():
        both = now.select(F.col("a").alias("id"), F.col("b").alias("near")).union(now.select("b", "a"))
        least = F.min(F.struct(F.xxhash64("near", F.lit(level)).alias("h"), F.col("near").alias("n")))
        parents = (
            both.union(both.select("near", "near")).groupBy("id").agg(least.alias("m"))
            .select("id", F.when(F.struct(F.xxhash64("id", F.lit(level)), F.col("id")) < F.col("m"), F.col("id")).otherwise(F.col("m.n")).alias("parent"))
        )
        parents = scratch.save(parents, f"{tag}_p{level}")
        levels.append(parents)
        left = parents.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        right = parents.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        half = now.join(left, "a").select("pa", "b").distinct()
        nxt = half.join(right, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct()
        nxt = scratch.save(nxt, f"{tag}_e{level + 1}")
        scratch.drop(f"{tag}_e{level}")
        now, level = nxt, level + 1
    if not levels:
        return edges.sparkSession.createDataFrame([], f"id {kind.simpleString()}, component {kind.simpleString()}")
    found = levels[-1].select("id", F.col("parent").alias("component"))
    for k in range(len(levels) - 2, -1, -1):
        upper = found.select(F.col("id").alias("parent"), F.col("component").alias("up"))
        found = levels[k].join(upper, "parent", "left").select("id", F.coalesce("up", "parent").alias("component"))
        found = scratch.save(found, f"{tag}_c{k}")
    return found
