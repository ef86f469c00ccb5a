"""A log-structured table: appended puts and deletes, flushed to sorted, numbered files.

The state is what the folder holds, so opening it again is recovery.  Writes are
Parquet appends, atomic by the commit protocol; files are sorted by key, so key
predicates skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import kvlog, sst

LOG_SCHEMA = "key {0}, batch bigint, n bigint, op string, value {0}"
FILE_SCHEMA = "key {0}, value {0}, is_deleted boolean, file_no int"
VERSION_SCHEMA = "file_no int, smallest {0}, largest {0}, num_entries bigint, data_bytes bigint, next_file_no int, level int"
FLUSH_BYTES = 4 << 20  # payload of the log after which the next write flushes it first


class LogStore:
    """put, delete, get, scan, seek and flush over DataFrames of keys and values.

    Within one append the last row of a key in the DataFrame's order wins, so
    give rows in order; across appends the later append wins.  Keys and values are
    strings, or bytes with ``kind`` binary.
    """

    def __init__(self, spark: SparkSession, path: str, flush_bytes: int = FLUSH_BYTES, kind: str = "string"):
        if kind not in ("string", "binary"):
            raise ValueError("kind is string or binary")
        self.spark, self.path, self.flush_bytes, self.kind = spark, path.rstrip("/"), flush_bytes, kind

    def _read(self, name: str, schema: str) -> DataFrame:
        schema = schema.format(self.kind)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    # Folders

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _remove(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def log(self) -> DataFrame:
        """Rows that no file has yet."""
        return self._read("log", LOG_SCHEMA)

    def files(self) -> DataFrame:
        """Entries of all files, tombstones included."""
        return self._read("files", FILE_SCHEMA)

    def next_file_no(self) -> int:
        return (self.files().agg(F.max("file_no").alias("m")).first()["m"] or 0) + 1

    # Writes

    def put(self, rows: DataFrame) -> None:
        """Append (key, value) rows."""
        self._append(rows.select("key", F.lit("put").alias("op"), "value"))

    def delete(self, keys: DataFrame) -> None:
        """Append tombstones, also for keys that are absent."""
        self._append(keys.select("key", F.lit("delete").alias("op"), F.lit(None).cast(self.kind).alias("value")))

    def write_batch(self, rows: DataFrame) -> None:
        """Append (key, op, value) rows as one commit."""
        self._append(rows.select("key", "op", "value"))

    def _append(self, rows: DataFrame) -> None:
        held = self.log().agg(
            F.sum(sst.record_bytes()).alias("bytes"), F.max("batch").alias("batch")
        ).first()
        if (held["bytes"] or 0) >= self.flush_bytes:
            self.flush()
            held = None
        batch = ((held["batch"] if held else None) or 0) + 1
        numbered = rows.select("key", F.lit(batch).cast("bigint").alias("batch"), F.monotonically_increasing_id().alias("n"), "op", "value")
        numbered.write.mode("append").parquet(f"{self.path}/log")

    def flush(self) -> int | None:
        """Write the log's latest rows as the next file and drop the log; the file's number, None without rows."""
        log = self.log()
        if log.isEmpty():
            return None
        number = self.next_file_no()
        last = kvlog.latest(log.withColumn("seq", F.struct("batch", "n")), "key").select("key", "value", (F.col("op") == "delete").alias("is_deleted"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        last.repartitionByRange(parts, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.path}/files/file_no={number}")
        self._install(number)
        self._remove("log")
        return number

    def _install(self, number: int) -> None:
        """Write the bounds of the new file beside those of all files before: the version that ``number`` makes."""
        name = f"files/file_no={number}"
        new = sst.manifest(self._read(name, FILE_SCHEMA.rpartition(",")[0]).withColumn("file_no", F.lit(number)))
        old = self.version(number - 1).withColumn("next_file_no", F.lit(number + 1))
        columns = [f.split()[0] for f in VERSION_SCHEMA.split(", ")]
        new.select(*columns).unionByName(old.select(*columns)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{number}")

    def version(self, number: int | None = None) -> DataFrame:
        """The files of a version, by default the latest, as they were written at its flush; no file is read."""
        number = self.next_file_no() - 1 if number is None else number
        return self._read(f"versions/{number}", VERSION_SCHEMA)

    # Reads

    def view(self) -> DataFrame:
        """Everything as one log (key, seq, op, value, file_no): what is in memory counts as the newest file."""
        top = self.next_file_no()
        log = self.log().select("key", F.struct(F.lit(top).alias("file_no"), "batch", "n").alias("seq"), "op", "value", F.lit(top).alias("file_no"))
        files = self.files().select(
            "key",
            F.struct("file_no", F.lit(0).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("n")).alias("seq"),
            F.when(F.col("is_deleted"), "delete").otherwise("put").alias("op"),
            "value",
            "file_no",
        )
        return files.unionByName(log)

    def get(self, keys: DataFrame, strict: bool = True) -> DataFrame:
        """(key, value) of the keys that are there; see ``kvlog.live_reads`` for ``strict``."""
        asked = self.view().join(keys.select("key").distinct(), "key", "left_semi")
        return kvlog.live_reads(asked, self.next_file_no(), strict)

    def scan(self) -> DataFrame:
        """Live rows in key order."""
        return kvlog.snapshot(self.view()).orderBy("key")

    def seek(self, target: str, n: int) -> DataFrame:
        return kvlog.seek(self.view(), target, n)

    def manifest(self) -> DataFrame:
        return sst.manifest(self.files())
