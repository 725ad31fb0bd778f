"""Parents and deviation families: products, counts under thresholds, piles, ordered selection.

``parents(parent_id, src, cost)`` meet ``families(family_id, src, dst, delta)`` on their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slackline.functions.candidates import classify
from slackline.operators.graph import ranked
from slackline.operators.ranges import running


def candidates(parents: DataFrame, families: DataFrame, at_most: int | None = None) -> DataFrame:
    """parent_id, family_id, src, dst, cost; with a bound, families that no parent can use are dropped before the join."""
    if at_most is not None:
        least = parents.groupBy("src").agg(F.min("cost").alias("least"))
        families = families.join(least, "src").where(F.col("least") + F.col("delta") <= at_most).drop("least")
    made = parents.join(families, "src").select("parent_id", "family_id", "src", "dst", (F.col("cost") + F.col("delta")).alias("cost"))
    return made if at_most is None else made.where(F.col("cost") <= at_most)


def class_counts(made: DataFrame, split: int, final: int | None = None, skip_long: bool = False) -> DataFrame:
    """class, n over candidates."""
    of = classify(F.col("cost"), F.lit(split), F.lit(final), F.lit(final is not None), F.lit(skip_long))
    return made.groupBy(of.alias("class")).agg(F.count("*").alias("n"))


def family_counts(parents: DataFrame, families: DataFrame, split: int, final: int | None = None) -> DataFrame:
    """family_id, n_short, n_long, n_skip, total: how many parents of each family fall where.

    A family's candidate is short if its parent costs no more than ``split - delta``, so a count is
    a parent's rank among thresholds: parents and thresholds of a source are sorted together and
    counted as they run, and no parent ever meets a family.
    """
    limits = [split] if final is None else [split, final]
    costs = parents.groupBy("src", F.col("cost").alias("value")).agg(F.count("*").alias("n")).withColumns({"which": F.lit(-1), "delta": F.lit(None).cast("long")})
    deltas = families.select("src", "delta").distinct()
    asked = [deltas.select("src", (F.lit(x) - F.col("delta")).alias("value"), F.lit(0).cast("long").alias("n"), F.lit(k).alias("which"), "delta") for k, x in enumerate(limits)]
    rows = costs
    for a in asked:
        rows = rows.unionByName(a)
    # At equal values parents, whose ``which`` is the least, come first: a threshold counts them.
    told = running(rows, "src", "value", ["which"], F.col("n"), "upto").where("which >= 0")
    total = parents.groupBy("src").agg(F.count("*").alias("total"))
    at = [F.max(F.when(F.col("which") == k, F.col("upto"))).alias(f"upto{k}") for k in range(len(limits))]
    counts = told.groupBy("src", "delta").agg(*at).join(total, "src")
    short = F.col("upto0")
    long = F.col("total") - short if final is None else F.greatest(F.col("upto1") - short, F.lit(0))
    counts = counts.select("src", "delta", short.alias("n_short"), long.alias("n_long"), (F.col("total") - short - long).alias("n_skip"), "total")
    return families.join(counts, ["src", "delta"]).select("family_id", "n_short", "n_long", "n_skip", "total")


def source_counts(parents: DataFrame, families: DataFrame, split: int, final: int) -> DataFrame:
    """src, n_short, n_long, n_skip, total over the candidates of each source."""
    per = families.select("family_id", "src").join(family_counts(parents, families, split, final), "family_id")
    return per.groupBy("src").agg(*(F.sum(c).alias(c) for c in ("n_short", "n_long", "n_skip", "total")))


#: Columns of the total order of candidates, the first that differs deciding; classes in the order SHORT, LONG, SKIP.
ORDER = ("cost", "parent_id", "edge_id", "dst", "class")


def total_order(made: DataFrame) -> list[Column]:
    """Sort keys of candidates: those of ORDER that ``made`` has; a family's id is its edge's."""
    key = {"edge_id": "edge_id" if "edge_id" in made.columns else "family_id"}
    by = {c: F.col(key.get(c, c)) for c in ORDER if key.get(c, c) in made.columns}
    if "class" in by:
        by["class"] = F.when(by["class"] == "SHORT", 0).when(by["class"] == "LONG", 1).otherwise(2)
    return list(by.values())


def first_n(made: DataFrame, n: int) -> DataFrame:
    """The n first candidates in total order, with their ``rank`` from 1."""
    first = made.orderBy(*total_order(made)).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*total_order(first))).cast("long"))  # n rows


def first_n_with_ties(made: DataFrame, n: int) -> DataFrame:
    """The n first and whatever costs as much as the n-th: a bounded top-n gives the cost, a filter the rows."""
    last = made.select("cost").orderBy("cost").limit(n).agg(F.max("cost")).scalar()
    return made.where(F.col("cost") <= last)


def under(made: DataFrame, threshold: int) -> DataFrame:
    return made.where(F.col("cost") <= threshold)


def pile_summary(made: DataFrame, split: int) -> DataFrame:
    """least, n_within, n_beyond of a pile of candidates that wait."""
    return made.agg(F.min("cost").alias("least"), F.count_if(F.col("cost") <= split).alias("n_within"), F.count_if(F.col("cost") > split).alias("n_beyond"))


def promote(made: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
    """The candidates that a higher split lets in, and the pile without them."""
    return made.where(F.col("cost") <= split), made.where(F.col("cost") > split)


def edge_lookup(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, edge_id, w of each pair; -1 and 0 where there is no such edge, the first of several."""
    first = edges.groupBy("src", "dst").agg(F.min(F.struct("edge_id", "w")).alias("e"))
    return pairs.join(first, ["src", "dst"], "left").select("src", "dst", F.coalesce("e.edge_id", F.lit(-1)).alias("edge_id"), F.coalesce("e.w", F.lit(0)).alias("w"))


def in_source_order(parents: DataFrame) -> DataFrame:
    """parents with ``k``: their place by cost within their source, from 1."""
    return running(parents, "src", "cost", ["parent_id"], F.lit(1), "k")


def source_slots(rows: DataFrame) -> DataFrame:
    """src, slot: dense numbers of the distinct sources, from 0; a row per source."""
    distinct = rows.select(F.col("src").alias("id"), F.lit(0).alias("all")).distinct()
    return ranked(distinct, "all").select(F.col("id").alias("src"), F.col("k").alias("slot"))


def tile_stats(per_source: DataFrame) -> DataFrame:
    """Occupancy of 16x16, 16x32 and 32x32 tiles over ``per_source(src, parents, families)``, in closed form per source."""
    rows = per_source.where("parents > 0 and families > 0").withColumn("products", F.col("parents") * F.col("families"))
    out = [F.count("*").alias("sources"), F.sum("families").alias("pairs"), F.sum("parents").alias("parents"), F.sum("products").alias("products"), F.max("parents").alias("max_parents"), F.max("families").alias("max_families"), F.max("products").alias("max_products")]
    for m, n in ((16, 16), (16, 32), (32, 32)):
        a, b, p, q = F.floor(F.col("parents") / m), F.floor(F.col("families") / n), F.col("parents") % m, F.col("families") % n
        tiles = (a + (p > 0).cast("long")) * (b + (q > 0).cast("long"))
        half = lambda x, m=m, n=n: F.when(2 * x >= m * n, x).otherwise(0)
        dense = a * b * m * n + a * half(m * q) + b * half(p * n) + half(p * q)
        out += [F.sum(a * b).alias(f"full_{m}x{n}"), F.sum(tiles - a * b).alias(f"partial_{m}x{n}"), F.sum(tiles * m * n).alias(f"capacity_{m}x{n}"), F.sum(dense).alias(f"dense_{m}x{n}")]
    return rows.agg(*out)
