"""Tables written in the folder that driver and executors share.

Iterative operators cut their lineage by writing a table here and reading it back, so a lost
executor costs only the tasks that it ran, and nothing sits in one executor's local storage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_roots: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset, on a local master only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="slackline-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _sweep() -> None:
    for spark, root in _roots:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, root)
        except Exception:  # noqa: BLE001  the session is gone; the folder is the cluster's to clear
            pass


atexit.register(_sweep)


class Scratch:
    """A fresh folder of Parquet tables; removed when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _roots.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_counted(self, df: DataFrame, name: str, told: Column):
        """``save``, and an aggregate over what was written, found on the way."""
        seen = Observation(name)
        return self.save(df.observe(seen, told.alias("told")), name), seen.get["told"]

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))
