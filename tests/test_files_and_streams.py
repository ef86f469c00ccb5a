"""File formats read back, and streams against their batch forms."""

import pytest
from pyspark.sql import functions as F

from siltstone.sources import kvfiles
from siltstone.streaming import invalidation

RECORDS = [("put", "key1", "value1"), ("put", "ключ", ""), ("delete", "key1", None)]
RAW = [("put", b"\xff\x00", b"\xfe"), ("put", b"", b"\x00"), ("delete", b"\xff\x00", None)]


def test_log_round_trip_and_cut(spark, tmp_path):
    kvfiles.register(spark)
    data = kvfiles.log_bytes(RECORDS)
    (tmp_path / "1.log").write_bytes(data)
    read = lambda: [(r.op, r.key, r.value) for r in spark.read.format("kvlog").option("text", "true").load(str(tmp_path)).orderBy("seq").collect()]
    assert read() == RECORDS
    for cut in range(len(data)):
        kept = list(kvfiles.read_log(data[:cut]))
        assert [(r[1], r[2].decode(), r[3] if r[3] is None else r[3].decode()) for r in kept] == RECORDS[: len(kept)]
        assert not kept or kept[-1][5] <= cut


def test_file_round_trip_seek_and_garbage(spark, tmp_path):
    kvfiles.register(spark)
    entries = [("b", "2", False), ("a", "1", False), ("c", None, True)]
    (tmp_path / "000007.sst").write_bytes(kvfiles.file_bytes(entries))
    (tmp_path / "000008.sst").write_bytes(b"short")
    files = spark.read.format("kvfile").option("text", "true").load(str(tmp_path))
    assert [tuple(r) for r in files.orderBy("ord").collect()] == [(7, 0, "a", "1", False), (7, 1, "b", "2", False), (7, 2, "c", None, True)]
    assert [r.value for r in files.where("key = 'b'").collect()] == ["2"]
    assert files.where("key = 'zz'").count() == 0


def test_arbitrary_bytes_round_trip_through_writers(spark, tmp_path):
    kvfiles.register(spark)
    logs, files = f"file://{tmp_path}/logs", f"file://{tmp_path}/files"
    spark.createDataFrame(RAW, "op string, key binary, value binary").coalesce(1).write.format("kvlog").mode("append").save(logs)
    assert [(r.op, bytes(r.key), r.value and bytes(r.value)) for r in spark.read.format("kvlog").load(logs).orderBy("seq").collect()] == RAW
    rows = spark.range(0, 1000).select(F.unhex(F.lpad(F.hex(F.col("id") * 60), 4, "0")).alias("key"), F.unhex(F.hex("id")).alias("value"), (F.col("id") % 7 == 0).alias("is_deleted"))
    held = {bytes(r.key): None if r.is_deleted else bytes(r.value) for r in rows.collect()}
    rows.repartitionByRange(3, "key").sortWithinPartitions("key").write.format("kvfile").option("first", "5").mode("append").save(files)
    read = spark.read.format("kvfile").load(files)
    got = read.collect()
    assert {bytes(r.key): r.value if r.value is None else bytes(r.value) for r in got} == held and {r.file_no for r in got} == {5, 6, 7}
    low, high = F.lit(bytearray(b"\x10\x00")), F.lit(bytearray(b"\x7f\xff"))
    for asked, keep in (
        ((F.col("key") >= low) & (F.col("key") < high), lambda k: b"\x10\x00" <= k < b"\x7f\xff"),
        ((F.col("key") > low) & (F.col("key") <= high), lambda k: b"\x10\x00" < k <= b"\x7f\xff"),
        (F.col("key") == F.lit(bytearray(b"\x00\x3c")), lambda k: k == b"\x00\x3c"),
    ):
        assert {bytes(r.key) for r in read.where(asked).collect()} == {k for k in held if keep(k)}
    rows.coalesce(1).sortWithinPartitions("key").limit(5).write.format("kvfile").mode("overwrite").save(files)
    assert spark.read.format("kvfile").load(files).count() == 5
    with pytest.raises(Exception, match="ascend"):
        rows.coalesce(1).sortWithinPartitions(F.desc("key")).write.format("kvfile").mode("append").save(files)


def test_seeks_read_only_what_they_ask_for():
    """A point get of the middle of a large file: footer, index and one entry."""
    import io

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            self.read_bytes += len(out)
            return out

    data = kvfiles.file_bytes([(b"k%06d" % n, b"v" * 1000, n % 2 == 0) for n in range(2000)])
    file = Counted(data)
    bounds = kvfiles.Bounds(low=b"k001001", high=b"k001001")
    assert [(n, k, v, d) for n, k, v, d in kvfiles.read_entries(file, len(data), bounds)] == [(1001, b"k001001", b"v" * 1000, False)]
    assert file.read_bytes < len(data) // 20
    for low in (b"", b"k001000", b"k0010005", b"k9"):
        for above in (False, True):
            for high in (None, b"k001003", b"k000999"):
                got = [k for _, k, _, _ in kvfiles.read_file(data, kvfiles.Bounds(low, above, high, above))]
                keys = [b"k%06d" % n for n in range(2000)]
                assert got == [k for k in keys if (k > low if above else k >= low) and (high is None or (k < high if above else k <= high))]
    for cut in range(0, 200, 3):
        list(kvfiles.read_file(data[:cut]))


def test_forgotten_state(spark, tmp_path):
    invalidation.keep_rocksdb(spark)
    schema = "key string, kind string, value string, at bigint, ts timestamp"
    at = lambda n: __import__("datetime").datetime(2024, 1, 1, 0, n)
    parts = [[("a", "load", "1", 1, at(0)), ("b", "load", "2", 2, at(0))], [("b", "load", "3", 9, at(30))], [("b", "load", "4", 10, at(31))], [("b", "load", "4", 10, at(31))]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = []
    states = invalidation.cache_state(stream, ttl_ms=600_000)
    query = states.writeStream.foreachBatch(lambda batch, _: seen.extend(tuple(r) for r in batch.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert ("a", None, False) in seen and [s for s in seen if s[0] == "b"][-1] == ("b", "4", True)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_cleanup_by_ticks(spark, tmp_path):
    spark.range(5).select(F.col("id").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    query = invalidation.cleanup(spark.readStream.schema("at bigint").parquet(str(tmp_path / "in")), seen.append, str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert seen == [4]


@pytest.mark.parametrize("turned", [False, True])
def test_invalidation_stream(spark, tmp_path, turned):
    invalidation.keep_rocksdb(spark)
    schema = "key string, kind string, value string, at bigint"
    parts = [[("a", "load", "1", 1), ("b", "load", "2", 2)], [("a", "invalidate", None, 5), ("a", "invalidate", None, 5)], [("a", "load", "3", 6), ("b", "invalidate", None, 1)]]
    for n, rows in enumerate(reversed(parts) if turned else parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = {}

    def take(batch, _):
        seen.update({r.key: (r.value, r.live) for r in batch.collect()})

    invalidation.cache_state(stream).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {"a": ("3", True), "b": ("2", True)}


def test_windows_close_with_the_watermark(spark, tmp_path):
    rows = spark.range(0, 100).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = invalidation.expired_windows(stream, "10 minutes", "0 minutes").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r.loads for r in spark.table("closed").collect()} <= {10} and spark.table("closed").count() == 9


def test_write_behind(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").cast("string").alias("key"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    invalidation.write_behind(stream, lambda batch, n: seen.extend(r.key for r in batch.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == ["0", "1", "2", "3", "4"]
