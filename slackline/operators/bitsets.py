"""Bit-vector slice sets: adjacency packed into masks of SIGMA bits by (row, interval)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.operators.graph import ranked

SIGMA, SLICES = 8, 128


def build(edges: DataFrame, row: str = "src", column: str = "dst") -> DataFrame:
    """interval, row_id, mask: which columns of an interval each row has. For deviations use row='dst', column='src'."""
    bit = F.expr(f"shiftleft(1, cast({column} % {SIGMA} as int))")
    return edges.groupBy(F.floor(F.col(column) / SIGMA).cast("long").alias("interval"), F.col(row).alias("row_id")).agg(F.bit_or(bit).alias("mask"))


def pack(slices: DataFrame, size: int = SLICES) -> DataFrame:
    """slices with chunk, slot, lane: at most ``size`` slices to a chunk of an interval, laid out over 32 lanes."""
    placed = ranked(slices.withColumnRenamed("row_id", "id"), "interval").withColumnRenamed("id", "row_id")
    return placed.select("interval", F.floor(F.col("k") / size).cast("int").alias("chunk"), (F.col("k") % size).cast("int").alias("slot"), (F.col("k") % 32).cast("int").alias("lane"), "row_id", "mask")


def summary(slices: DataFrame) -> DataFrame:
    """slices, bits, ratio: set bits of those there is room for; 0 if there is none."""
    got = slices.agg(F.count("*").alias("slices"), F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).alias("bits"))
    return got.withColumn("ratio", F.when(F.col("slices") > 0, F.round(F.col("bits") / (F.col("slices") * SIGMA), 6)).otherwise(0.0))


def decode(slices: DataFrame, row: str = "src", column: str = "dst") -> DataFrame:
    bits = F.explode(F.expr(f"filter(sequence(0, {SIGMA - 1}), b -> (shiftright(mask, b) & 1) = 1)"))
    return slices.select(F.col("row_id").alias(row), "interval", bits.alias("b")).select(row, (F.col("interval") * SIGMA + F.col("b")).alias(column))


def mismatches(slices: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst that are only in the slices or only in the edges; empty if they say the same."""
    a, b = decode(slices), edges.select("src", F.col("dst").cast("long").alias("dst")).distinct()
    return a.join(b, ["src", "dst"], "left_anti").unionByName(b.join(a, ["src", "dst"], "left_anti"))


def frontier(ids: DataFrame) -> DataFrame:
    """interval, front: an active set as masks."""
    return ids.groupBy(F.floor(F.col("id") / SIGMA).cast("long").alias("interval")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(id % {SIGMA} as int))")).alias("front"))


def active_slices(slices: DataFrame, front: DataFrame) -> DataFrame:
    """Slices that share a bit with the frontier, with ``hit``, the shared bits."""
    return slices.join(front, "interval").withColumn("hit", F.col("mask").bitwiseAND(F.col("front"))).where("hit <> 0")


def discover(dev_slices: DataFrame, active: DataFrame) -> DataFrame:
    """src, dst: deviations that leave an active source; slices are by dst."""
    hit = active_slices(dev_slices, frontier(active)).select("interval", "row_id", F.col("hit").alias("mask"))
    return decode(hit, row="dst", column="src").select("src", "dst")


def pull_step(slices: DataFrame, front: DataFrame, visited: DataFrame) -> DataFrame:
    """id: rows that reach the frontier in one edge and were not visited."""
    hit = active_slices(slices, frontier(front)).select(F.col("row_id").alias("id")).distinct()
    return hit.join(visited.select("id"), "id", "left_anti")
