"""Files of a log store: record offsets, torn tails, manifests and range pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import octets

# Fixed value: type byte and two 4-byte lengths around key and value.
RECORD_OVERHEAD = 9

MAX_PROBES = 100_000


def record_bytes() -> Column:
    """Bytes of a log or file record; deletes carry no value."""
    value = F.coalesce(octets(F.col("value")), F.lit(0))
    return (F.lit(RECORD_OVERHEAD) + octets(F.col("key")) + value).cast("bigint")


def wal_offsets(log: DataFrame) -> DataFrame:
    """First and past-last byte of every record; the log restarts with each generation."""
    rows = log.withColumn("value", F.when(F.col("op") == "put", F.col("value"))).withColumn("bytes", record_bytes())
    running = Window.partitionBy("file_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end_offset", F.sum("bytes").over(running)).withColumn("start_offset", F.col("end_offset") - F.col("bytes"))


def truncate_torn(offsets: DataFrame, file_bytes: int) -> DataFrame:
    """Whole records of logs that were cut at ``file_bytes``."""
    return offsets.where(F.col("end_offset") <= file_bytes)


def manifest(files: DataFrame) -> DataFrame:
    """Bounds, entries and data bytes of each file, and the next free number."""
    per_file = files.withColumn("bytes", record_bytes()).groupBy("file_no").agg(
        F.min("key").alias("smallest"),
        F.max("key").alias("largest"),
        F.count("*").alias("num_entries"),
        F.sum("bytes").alias("data_bytes"),
    )
    top = per_file.agg((F.max("file_no") + 1).alias("next_file_no"))  # reads the exchange of per_file again
    return per_file.join(F.broadcast(top)).withColumn("level", F.lit(0))  # one row: an aggregate without keys


def candidate_files(manifest_df: DataFrame, probes: DataFrame, max_probes: int = MAX_PROBES) -> DataFrame:
    """(key, file_no) of files whose range covers a probe.

    The probes, distinct and at most ``max_probes`` (more is an error), go to the
    files as one sorted array, so that a row of the result is made only where a
    range covers a key.
    """
    few = probes.select("key").where("key IS NOT NULL").distinct().limit(max_probes + 1)
    listed = few.agg(F.sort_array(F.collect_list("key")).alias("keys"))
    bounded = F.when(F.size("keys") <= max_probes, F.col("keys")).otherwise(F.raise_error(F.lit(f"more than {max_probes} probes")))
    covered = F.filter("keys", lambda k: k.between(F.col("smallest"), F.col("largest")))
    return manifest_df.join(F.broadcast(listed.select(bounded.alias("keys")))).select(F.explode(covered).alias("key"), "file_no")


def entry_offsets(files: DataFrame) -> DataFrame:
    """Byte offset of every entry of a file, entries in key order."""
    rows = files.withColumn("bytes", record_bytes())
    running = Window.partitionBy("file_no").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("entry_offset", F.sum("bytes").over(running) - F.col("bytes")).select("file_no", "key", "entry_offset", "is_deleted")
