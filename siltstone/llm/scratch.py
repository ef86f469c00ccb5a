"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A table written here survives the loss of any executor, cuts the lineage and
gives the optimizer exact sizes.  Where the setting is absent (tests, a single
machine) a folder of our own is made and set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared checkpoint folder as a URI or path, without trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    own = tempfile.mkdtemp(prefix="siltstone-scratch-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def refuse_clash(keep: list[Column | str] | None, *made: str) -> None:
    """An error where kept columns are named like those that an operator makes."""
    clash = {c for c in keep or [] if isinstance(c, str)} & set(made)
    if clash:
        raise ValueError(f"keep has columns of the result: {sorted(clash)}")


def _delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """One folder of Parquet tables that belongs to one run of an operator.

    ``drop`` removes tables that no later plan reads, ``close`` all of them.  What
    is left goes when the driver process ends, since a lazy result may still read
    it until then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.uri = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._quietly_remove)

    def _quietly_remove(self) -> None:
        try:
            _delete(self.spark, self.uri)
        except Exception:  # the session may be gone already at exit
            pass

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.uri}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.uri}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.uri}/{name}")

    def close(self) -> None:
        _delete(self.spark, self.uri)
