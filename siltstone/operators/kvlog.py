"""Reads of a put/delete log: latest-wins merging, tombstones, scans and seeks.

A log has key, seq (anything with an order), op ('put' or 'delete'), value and
file_no, the generation a row was flushed with.  Deletes are kept until a merge
has picked the latest row of each key; dropping them earlier would bring older
values back.  Predicates on key commute with the merge and reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_log(events: DataFrame) -> DataFrame:
    """The test log: users are keys, errors are deletes, and the days since 1970 are generations."""
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("key"),
        F.struct("ts", "event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.concat_ws(":", "event_type", "event_id").alias("value"),
        F.unix_date(F.col("ts").cast("date")).alias("file_no"),
    )


def user_events(events: DataFrame, key: str) -> DataFrame:
    """The events behind one key of ``event_log``: a predicate on the stored column, which reaches the scan."""
    number = key.removeprefix("user-")
    if not key.startswith("user-") or not number.isascii() or not number.isdigit() or str(int(number)) != number:
        return events.where(F.lit(False))
    return events.where(F.col("user_id") == int(number))


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The latest row of each group: ``by`` columns, op and value; deletes have no value."""
    merged = log.groupBy(*by).agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return merged.select(*by, F.col("last.op").alias("op"), F.when(F.col("last.op") == "put", F.col("last.value")).alias("value"))


def snapshot(log: DataFrame) -> DataFrame:
    """Live keys and values."""
    return latest(log, "key").where("op = 'put'").select("key", "value")


def point_get(log: DataFrame, key: str) -> DataFrame:
    """The current value of one key: one row, or none."""
    return snapshot(log.where(F.col("key") == key))


def raw_scan(log: DataFrame) -> DataFrame:
    """What each file holds: the latest row of a key in it, tombstones included."""
    return latest(log, "file_no", "key").select("file_no", "key", "value", (F.col("op") == "delete").alias("is_deleted"))


def seek(log: DataFrame, target: str, n: int) -> DataFrame:
    """The first n live keys at or after ``target``, in byte order."""
    return snapshot(log.where(F.col("key") >= target)).orderBy("key").limit(n)


def merge_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe key: code 0 (absent), 1 (found) or 2 (deleted), the value, and the newest file that has it."""
    asked = probes.select("key").distinct()
    held = log.join(asked, "key", "left_semi")  # before any merging
    newest = raw_scan(held).groupBy("key").agg(F.max_by(F.struct("file_no", "value", "is_deleted"), "file_no").alias("hit"))
    return probes.select("key").join(newest, "key", "left").select(
        "key",
        F.when(F.col("hit").isNull(), 0).when(F.col("hit.is_deleted"), 2).otherwise(1).alias("code"),
        F.col("hit.file_no").alias("file_no"),
        F.col("hit.value").alias("value"),
    )


def live_reads(log: DataFrame, memtable_no: int | None = None, strict: bool = True) -> DataFrame:
    """Live keys when the highest generation is still in memory.

    Strict: a tombstone in memory hides what files hold.  Otherwise it doesn't,
    and a read falls through to the newest file, until it is flushed itself.
    """
    if strict:
        return snapshot(log)
    top = log.agg(F.max("file_no").alias("top")) if memtable_no is None else None
    if top is not None:
        memtable_no = top.first()["top"]
    in_memory = F.col("file_no") == F.lit(memtable_no)
    sides = log.groupBy("key").agg(
        F.max_by(F.when(in_memory, F.struct("op", "value")), F.when(in_memory, F.col("seq"))).alias("mem"),
        F.max_by(F.when(~in_memory, F.struct("op", "value")), F.when(~in_memory, F.col("seq"))).alias("sst"),
    )
    found = F.when(F.col("mem.op") == "put", F.col("mem.value")).when(F.col("sst.op") == "put", F.col("sst.value"))
    return sides.select("key", found.alias("value")).where("value IS NOT NULL")
