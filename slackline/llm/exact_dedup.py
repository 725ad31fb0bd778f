"""Exact dedup on a persistent digest index, bucketed and sorted by hash.

The index is a folder of Parquet files, one row per distinct text ever seen, with its bucket count
beside them. New rows are reduced to digests, pre-aggregated to one row per digest, kept from the
index by a sort-merge anti-join on its buckets (the index side is neither shuffled nor re-read as
text), and appended. The bucketed table is registered under a name of its own while it is needed.

Defined cases: null text counts as empty and empty texts are equal to each other; a null doc_id
stays only if every equal text has one; rows that repeat a doc_id with equal text are one row in
``decisions`` terms, of which the first copy stays; an empty table gives an empty result; columns
other than doc_id and text are carried by ``keep_first``, whatever their names, and otherwise
ignored. An index keeps the bucket count that it was made with, whatever the session's. A batch
name that comes again is the same batch come again, whole after a crash or with more rows: texts
that the index lacks are appended, none is lost, and rows that stayed before stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm.names import free
from slackline.plans.scratch import Scratch

SPACE = " \t\n\x0b\x0c\r"


def normal_text(text: F.Column) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def digest_rows(docs: DataFrame) -> DataFrame:
    """One narrow row per (doc_id, digest, n_points): ``copies`` counts repeated rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(normal_text(F.col("text")), 256)).alias("digest"), F.char_length(text).cast("long").alias("n_points"))
    return rows.groupBy("doc_id", "digest", "n_points").agg(F.count("*").alias("copies"))


class DigestIndex:
    """The rows at ``path``: digest, keep_id, n_points, copies, batch; bucketed and sorted by digest."""

    SCHEMA = "digest BINARY, keep_id BIGINT, n_points BIGINT, copies BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        about = f"{self.path}/_about"  # readers of the folder pass over names that begin so
        folder = spark._jvm.org.apache.hadoop.fs.Path(about)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            self.buckets = spark.read.schema("buckets INT").json(about).first()["buckets"]
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        else:
            if folder.getParent().getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder.getParent()) and not self.files().isEmpty():
                raise ValueError(f"{path} holds files, but not the bucket count of an index")
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).selectExpr(f"{self.buckets} AS buckets").coalesce(1).write.mode("overwrite").json(about)

    @contextmanager
    def table(self) -> Iterator[str]:
        """The name of a table over the files with their bucket contract; the files outlive it."""
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet OPTIONS (path '{self.path}') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def files(self) -> DataFrame:
        """The same rows without the bucket contract: a later join may deal both sides out anew."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds what the index lacks; to be called again after a crash, it adds what is still missing."""
        best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg")))
        groups = rows.groupBy("digest").agg(best.alias("best"), F.sum("copies").alias("copies"))
        # Written first: an anti-join planned over the aggregate would be moved below it, to rows not yet combined.
        groups = Scratch(self.spark, "digest_groups").save(groups, "groups")
        with self.table() as name:
            fresh = groups.join(self.spark.table(name).select("digest").hint("merge"), "digest", "left_anti")
            fresh = fresh.select("digest", (-F.col("best.neg")).alias("keep_id"), "best.n_points", "copies", F.lit(batch).alias("batch"))
            fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)


def _decisions(docs: DataFrame, index_path: str | None, batch: str | None) -> DataFrame:
    if batch is None:
        if index_path is not None:
            raise ValueError("an index that lasts needs a name for each batch")
        batch = "batch-0"
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    rows = scratch.save(digest_rows(docs), "rows")
    index = DigestIndex(spark, index_path or scratch.path("index"))
    index.append(rows, batch)
    known = index.files().select("digest", "keep_id", F.col("copies").alias("group_size"), F.col("batch").alias("from"), F.col("n_points").alias("keep_points"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")) & (F.col("from") == batch)
    lacking = F.raise_error(F.lit("the index lacks a text that was just appended")).cast("boolean")
    return rows.join(known, "digest", "left").withColumn("stays", F.when(F.col("from").isNull(), lacking).otherwise(stays))


def exact_dedup(docs: DataFrame, index_path: str | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal when identical after deleting every space, tab, line feed, vertical tab, form
    feed and carriage return. Of a text not yet in the index, the row of most code points, then
    least doc_id, stays. Of a text that an earlier batch brought, none stays: keep_id is that
    batch's. group_size counts the rows that brought the text. ``index_path`` demands ``batch``.
    """
    return (
        _decisions(docs, index_path, batch)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def keep_first(docs: DataFrame, index_path: str | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of wholly repeated rows, one."""
    own = free(docs.columns, "id__", "digest__", "points__")
    stay = _decisions(docs, index_path, batch).where("stays").select("doc_id", "digest", "n_points", "copies")
    stay = Scratch(docs.sparkSession, "keep_first").save(stay, "stay")
    i, d, n = map(F.col, own)
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(i) & (F.unhex(F.sha2(normal_text(F.col("text")), 256)) == d) & (F.char_length(text) == n)

    def of(copies: str) -> DataFrame:
        return docs.join(stay.where(copies).select("doc_id", "digest", "n_points").toDF(*own), same)

    if stay.where("copies > 1").isEmpty():
        return of("copies = 1").drop(*own)
    return of("copies = 1").drop(*own).unionByName(of("copies > 1").dropDuplicates(own).drop(*own))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM g WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
