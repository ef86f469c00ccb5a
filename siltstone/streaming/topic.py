"""A message queue of keys as a folder: publishing appends files, subscribing is a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "key string"


class Topic:
    """Keys published under one name; every subscriber reads all that is published, each at its own pace."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)

    def publish(self, keys: DataFrame) -> None:
        keys.select("key").write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(SCHEMA).parquet(self.path)

    def subscribe(self, handler: Callable[[DataFrame, int], None], checkpoint: str, until_empty: bool = False):
        """Start handing batches of keys to ``handler(batch, id)``; with ``until_empty`` the query ends once all is read.

        ``checkpoint`` is the subscriber's own folder: it remembers how far it has read.
        """
        writer = self.stream().writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if until_empty else writer).start()
