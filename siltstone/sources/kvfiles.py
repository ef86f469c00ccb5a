"""Python data sources for the two file formats of a log store: readers and writers.

Log record:  type (1 byte: 0 put, else delete), key length (4), key, value length (4), value.
File entry:  key length (4), key, value length (4), value, type (1); then an
index of count (4) and key length, key, offset (8) each; then the index offset (8).
Integers are little-endian.  Both readers stop at the first record that is not whole.

Keys and values are bytes; with the option ``text`` they are strings, and bytes
that aren't UTF-8 are an error.  Paths may be of any store that Arrow can open
(local, hdfs, s3, gs).  A reader of sorted files takes equality and bounds of the
key from the query: it reads the footer and the index, finds the first entry by
bisection, and reads entries from there to the upper bound.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

_INT, _LONG = struct.Struct("<I"), struct.Struct("<Q")
Bytes = bytes | str


def _raw(x: Bytes | None) -> bytes:
    return b"" if x is None else x.encode() if isinstance(x, str) else bytes(x)


def _record(op: str, key: Bytes, value: Bytes | None) -> bytes:
    k, v = _raw(key), b"" if op != "put" else _raw(value)
    return bytes([0 if op == "put" else 1]) + _INT.pack(len(k)) + k + _INT.pack(len(v)) + v


def log_bytes(records: Iterable[tuple[str, Bytes, Bytes | None]]) -> bytes:
    """A log of (op, key, value) records."""
    return b"".join(_record(*r) for r in records)


def _file_parts(entries: Iterable[tuple[Bytes, Bytes | None, bool]]) -> Iterator[bytes]:
    """The bytes of a file from entries in ascending order of key; only the index is held."""
    index, at, n, before = bytearray(), 0, 0, None
    for key, value, deleted in entries:
        k, v = _raw(key), b"" if deleted else _raw(value)
        if before is not None and k <= before:
            raise ValueError("keys of a file must ascend: sort rows by key within partitions, one row a key")
        before = k
        index += _INT.pack(len(k)) + k + _LONG.pack(at)
        part = _INT.pack(len(k)) + k + _INT.pack(len(v)) + v + bytes([bool(deleted)])
        at, n = at + len(part), n + 1
        yield part
    yield _INT.pack(n) + bytes(index) + _LONG.pack(at)


def file_bytes(entries: Iterable[tuple[Bytes, Bytes | None, bool]]) -> bytes:
    """A file of (key, value, is_deleted) entries, which it sorts by key."""
    return b"".join(_file_parts(sorted(entries, key=lambda e: _raw(e[0]))))


def read_log(data: bytes) -> Iterator[tuple[int, str, bytes, bytes | None, int, int]]:
    at, seq = 0, 0
    while at + 5 <= len(data):
        size = _INT.unpack_from(data, at + 1)[0]
        value_at = at + 5 + size
        if value_at + 4 > len(data):
            return
        end = value_at + 4 + _INT.unpack_from(data, value_at)[0]
        if end > len(data):
            return
        put = data[at] == 0
        yield seq, "put" if put else "delete", data[at + 5 : value_at], data[value_at + 4 : end] if put else None, at, end
        at, seq = end, seq + 1


@dataclass
class Bounds:
    """Keys that a query asks for: from ``low`` (after it, if ``above``) to ``high`` (before it, if ``below``)."""

    low: bytes | None = None
    above: bool = False
    high: bytes | None = None
    below: bool = False

    def add(self, f: Filter) -> bool:
        """Take a filter on the key, if it is a bound."""
        if getattr(f, "attribute", None) != ("key",) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or f.value is None:
            return False
        value = _raw(f.value)
        if not isinstance(f, LessThan | LessThanOrEqual):
            new = (value, isinstance(f, GreaterThan))
            if self.low is None or new > (self.low, self.above):
                self.low, self.above = new
        if not isinstance(f, GreaterThan | GreaterThanOrEqual):
            new = (value, not isinstance(f, LessThan))
            if self.high is None or new < (self.high, not self.below):
                self.high, self.below = value, isinstance(f, LessThan)
        return True

    def before(self, key: bytes) -> bool:
        return self.low is not None and (key <= self.low if self.above else key < self.low)

    def after(self, key: bytes) -> bool:
        return self.high is not None and (key >= self.high if self.below else key > self.high)


def read_file(data: bytes, bounds: Bounds | None = None) -> Iterator[tuple[int, bytes, bytes | None, bool]]:
    """(position, key, value, is_deleted) of the entries within bounds; none if the footer does not point into the file."""
    import io

    return read_entries(io.BytesIO(data), len(data), bounds or Bounds())


def read_index(index: bytes) -> tuple[list[bytes], list[int]]:
    """Keys and offsets of an index, as far as it is whole."""
    keys, offsets, at = [], [], 4
    for _ in range(_INT.unpack_from(index)[0] if len(index) >= 4 else 0):
        if at + 4 > len(index):
            break
        end = at + 4 + _INT.unpack_from(index, at)[0]
        if end + 8 > len(index):
            break
        keys.append(index[at + 4 : end])
        offsets.append(_LONG.unpack_from(index, end)[0])
        at = end + 8
    return keys, offsets


def read_entries(file, size: int, bounds: Bounds) -> Iterator[tuple[int, bytes, bytes | None, bool]]:
    """As ``read_file``, of an open file: its footer, its index, and only the entries asked for."""
    if size < 8:
        return
    file.seek(size - 8)
    stop = _LONG.unpack(file.read(8))[0]
    if stop >= size:
        return
    file.seek(stop)
    keys, offsets = read_index(file.read(size - 8 - stop))
    first = bisect_left(keys, bounds.low) if bounds.low is not None else 0
    if bounds.above and first < len(keys) and keys[first] == bounds.low:
        first += 1
    last = first
    while last < len(keys) and not bounds.after(keys[last]):
        last += 1
    if first == last:
        return
    end = offsets[last] if last < len(keys) else stop
    file.seek(offsets[first])
    data, at, base = file.read(end - offsets[first]), 0, first
    while at + 4 <= len(data):
        value_at = at + 4 + _INT.unpack_from(data, at)[0]
        past = value_at + 4 + _INT.unpack_from(data, value_at)[0] + 1 if value_at + 4 <= len(data) else len(data) + 1
        if past > len(data):
            return
        deleted = data[past - 1] != 0
        yield base, data[at + 4 : value_at], None if deleted else data[value_at + 4 : past - 1], deleted
        at, base = past, base + 1


def _store(path: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(parts.path)
    return fs.FileSystem.from_uri(path)


class _Files(DataSourceReader):
    def __init__(self, path: str, suffix: str, text: bool):
        self.path, self.suffix, self.bounds = path, suffix, Bounds()
        self.shown = (lambda x: None if x is None else x.decode()) if text else (lambda x: x)

    def partitions(self) -> list[InputPartition]:
        """A file each; an empty folder has one partition of nothing."""
        store, path = _store(self.path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.File:
            return [InputPartition(path)]
        files = store.get_file_info(fs.FileSelector(path))
        return [InputPartition(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(self.suffix)] or [InputPartition(None)]

    def open(self, path: str):
        return _store(self.path)[0].open_input_file(path)


class _LogReader(_Files):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        with self.open(partition.value) as f:
            for seq, op, key, value, start, end in read_log(f.read()):
                yield seq, op, self.shown(key), self.shown(value), start, end


class _FileReader(_Files):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and bounds of the key are answered here; everything else is left to Spark."""
        for f in filters:
            if not self.bounds.add(f):
                yield f

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        named = re.search(r"(\d+)\D*$", os.path.basename(partition.value))
        with self.open(partition.value) as f:
            for n, key, value, deleted in read_entries(f, f.size(), self.bounds):
                yield int(named[1]) if named else 0, n, self.shown(key), self.shown(value), deleted


@dataclass
class _Written(WriterCommitMessage):
    draft: str
    final: str


class _Writer(DataSourceWriter):
    """One file a task, under a name of its own until the whole write is committed."""

    def __init__(self, path: str, suffix: str, first: int, overwrite: bool):
        self.path, self.suffix, self.first, self.overwrite = path, suffix, first, overwrite

    def parts(self, rows: Iterator[Row]) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        draft = f"{folder}/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            for part in self.parts(iterator):
                out.write(part)
        return _Written(draft, f"{folder}/{self.first + TaskContext.get().partitionId():06d}{self.suffix}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _store(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.path.endswith(self.suffix):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(m.draft, m.final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None and store.get_file_info(m.draft).type == fs.FileType.File:
                store.delete_file(m.draft)


class _LogWriter(_Writer):
    def parts(self, rows: Iterator[Row]) -> Iterator[bytes]:
        for r in rows:
            yield _record(r["op"], r["key"], r["value"])


class _FileWriter(_Writer):
    def parts(self, rows: Iterator[Row]) -> Iterator[bytes]:
        yield from _file_parts((r["key"], r["value"], r["is_deleted"]) for r in rows)


class _Source(DataSource):
    suffix, columns = "", ""
    reading: type[_Files]
    writing: type[_Writer]

    def _text(self) -> bool:
        return self.options.get("text", "false").lower() == "true"

    def schema(self) -> str:
        return self.columns.format("string" if self._text() else "binary")

    def reader(self, schema) -> DataSourceReader:
        return self.reading(self.options["path"], self.suffix, self._text())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return self.writing(self.options["path"], self.suffix, int(self.options.get("first", "1")), overwrite)


class LogSource(_Source):
    """``spark.read.format("kvlog").load(path)``: a log file, or a folder of .log files; writing takes op, key and value.

    Rows are written in the order of their partitions, a log each, numbered from
    the option ``first``.
    """

    suffix, columns = ".log", "seq bigint, op string, key {0}, value {0}, start_offset bigint, end_offset bigint"
    reading, writing = _LogReader, _LogWriter

    @classmethod
    def name(cls) -> str:
        return "kvlog"


class TableFileSource(_Source):
    """``spark.read.format("kvfile").load(path)``: a sorted file, or a folder of .sst files; writing takes key, value and is_deleted.

    Rows must be sorted by key within partitions; each partition becomes a file,
    numbered from the option ``first``.
    """

    suffix, columns = ".sst", "file_no int, ord bigint, key {0}, value {0}, is_deleted boolean"
    reading, writing = _FileReader, _FileWriter

    @classmethod
    def name(cls) -> str:
        return "kvfile"


def register(spark: SparkSession) -> None:
    """Make both formats known, and let key filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)
    spark.dataSource.register(TableFileSource)
