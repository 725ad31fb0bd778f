"""From raw documents to packed training sequences, in stages that each apply one operator.

Every stage is written as Parquet and read back as the next one's input, so each can be run again
by itself. The result cannot be given by SQL (learned scores, MinHash pruning, tokenizer ids).

Defined cases, by stage as the operators define them. Null and empty texts are clean; they are equal
to each other, so exact dedup leaves one of all of them; that one has no shingles and stays; it has
no tokens and goes or stays with the order keys around it; it packs as the closing id alone. Rows
without a doc_id stay only where no equal or near text has one, and go to the mix under the order
key of the empty id. Rows that repeat a doc_id are rows each; wholly repeated rows are one row after
exact dedup. Without labels of both kinds the fixed word list judges toxicity. An empty table gives
an empty result. Further columns of documents are carried up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slackline.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from slackline.llm.names import free
from slackline.plans.scratch import Scratch

MIX = mixing.MixPlan(budget_share=0.8, max_epochs=2, seed=17)
#: Rows that Python workers take at a time, and bytes of a half of their word table in packing: five stages share an executor's memory.
ROWS, CACHE_BYTES = 2000, 24 << 20


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(int(spark.conf.get(key)), ROWS)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (epoch,) = free(docs.columns, "epoch")
    return mixing.mix(docs, MIX, epoch=epoch).drop(epoch)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack(docs, packing.default_tokenizer(), CACHE_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = done if k == len(STAGES) - 1 else scratch.save(done, f"{k}_{name}")
    return docs
