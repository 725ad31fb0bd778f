"""Labelled rows for the classifiers: folds by hash of the id, and a bounded sample to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int) -> DataFrame:
    """text, label, part: at most ``bound`` labelled rows outside the held-out fold, in hash order.

    A doc_id labelled twice and equal texts count once, with their least label; null labels and null
    texts are not sampled. ``part`` is 0, 1 or 2 by hash, for fitting in two steps.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # `bound` rows of 12 bytes: safe to broadcast
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("text").agg(F.min("label").alias("label")).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(3)).cast("int"))
