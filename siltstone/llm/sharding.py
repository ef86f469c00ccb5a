"""Sharding by a Hilbert curve over several metadata dimensions.

Every document gets a cell in a grid of quantised metadata; cells are numbered
along a Hilbert curve, rows are range-sorted by that number, and the sorted
order is cut into runs of equal row counts (the law ``rows``).  Neighbouring
shards are then narrow in every dimension, so min/max statistics of a shard
(``shard_bounds``) prune on each of them.

A dimension is quantised by quantiles: the values, merged first and each weighted
with its rows, are range-sorted and cut into 2^bits cells of about equal rows.
Only the least value of each cell comes to the driver.

The text never leaves the JVM: its size and checksum are computed in one scan and
written; all else reads those columns, and only they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import with_rank
from .scratch import Scratch

BITS = 10


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of points, ``cells`` being (dimensions, points) of ``bits`` each.

    The transposed form of the curve: undo the excess rotations from the top
    bit down, then Gray-decode, then interleave.
    """
    x = cells.astype(np.int64).copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = (x[0] ^ x[d]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = np.where(high, x[d], x[d] ^ swap)
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


PREFIX = 256  # characters of a text value that quantising looks at


def cell_bounds(scratch: Scratch, rows: DataFrame, column: str, bits: int = BITS) -> list[tuple[int, object]]:
    """(cell, least value) in order; a value's cell is its share of rows before it, times 2^bits.

    At most 2^bits of them; values are numbers, or texts of which PREFIX
    characters count.
    """
    spark = scratch.spark
    held = scratch.save(rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), f"values-{column}")
    kind = held.schema["value"].dataType.simpleString()

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("value"), batch.column("n"), pa.array(ends - n), pa.array(np.full(len(n), part, np.int64))], ["value", "n", "before", "part"]
            )
            before = int(ends[-1]) if len(n) else before

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.repartitionByRange(parts, "value").sortWithinPartitions("value")
    placed = scratch.save(dealt.mapInArrow(running, f"value {kind}, n bigint, before bigint, part bigint"), f"running-{column}")
    starts, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        starts.append((part, total))
        total += n
    if not total:
        return []
    first = spark.createDataFrame(starts, "part bigint, start bigint")  # a row for each shuffle partition
    cell = F.expr(f"cast((before + start) * {1 << bits} div {total} as int)")
    found = placed.join(F.broadcast(first), "part").groupBy(cell.alias("cell")).agg(F.min("value").alias("value")).collect()
    return sorted((r["cell"], r["value"]) for r in found)


def hilbert_shards(
    spark: SparkSession,
    rows: DataFrame,
    dimensions: list[str],
    order: list[str],
    shards: int,
    bits: int = BITS,
    label: str = "hilbert",
) -> DataFrame:
    """``rows`` with curve, shard and slot.

    ``dimensions`` are columns of numbers or texts; null texts count as empty,
    null numbers as 0.  ``order`` breaks ties along the curve.  Counts of shards
    differ by at most one; slots run from 0.  Rows equal in all of ``order`` are
    interchangeable.  No rows give no rows.
    """
    taken = set(rows.columns)
    if taken & {"curve", "shard", "slot", "rank", "_part", "_index"} or any(c.startswith("_h_") for c in taken):
        raise ValueError("rows may not have the columns curve, shard, slot, rank, _part and _index, or any that begins with _h_")
    if bits * len(dimensions) > 62:
        raise ValueError("bits times dimensions may be 62 at most")
    scratch = Scratch(spark, label)
    text = lambda d: rows.schema[d].dataType.typeName() == "string"
    value = lambda d: F.substring(F.coalesce(d, F.lit("")), 1, PREFIX) if text(d) else F.coalesce(d, F.lit(0))
    valued = rows.withColumns({f"_h_{k}": value(d) for k, d in enumerate(dimensions)})
    bounds = [cell_bounds(scratch, valued, f"_h_{k}", bits) for k in range(len(dimensions))]
    # Texts are compared as UTF-8 bytes, as Spark sorts them.
    least = [np.array([v.encode() if isinstance(v, str) else v for _, v in b], object if b and isinstance(b[0][1], str) else None) for b in bounds]
    cells = [np.array([c for c, _ in b], np.int64) for b in bounds]
    columns = rows.columns

    def cell(k: int, held: pa.Array) -> np.ndarray:
        if least[k].dtype == object:
            names = held.dictionary_encode()
            spots = np.searchsorted(least[k], np.array([v.encode() for v in names.dictionary.to_pylist()], object), side="right") - 1
            return cells[k][spots][names.indices.to_numpy()]
        return cells[k][np.searchsorted(least[k], held.to_numpy(), side="right") - 1]

    def add_curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            curve = hilbert_index(np.array([cell(k, batch.column(f"_h_{k}")) for k in range(len(least))]), bits)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(curve)], [*columns, "curve"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    curved = scratch.save(valued.mapInArrow(add_curve, f"{schema}, curve bigint"), "curved")
    ranked, total = with_rank(spark, curved, [F.col(c) for c in ("curve", *order)], scratch, "placed")
    rank = F.col("rank")
    size, more = divmod(total, shards)  # the first ``more`` shards have one row more
    long_end = more * (size + 1)
    shard = F.when(rank < long_end, F.expr(f"rank div {size + 1}")).otherwise(
        F.lit(more) + F.expr(f"(rank - {long_end}) div {max(size, 1)}")
    )
    slot = F.when(rank < long_end, rank % (size + 1)).otherwise((rank - long_end) % max(size, 1))
    return ranked.withColumns({"shard": shard.cast("int"), "slot": slot.cast("bigint")}).drop("rank")


def shard_bounds(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """(shard, rows, and least and most of each column): what a reader prunes files by."""
    sides = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *sides)


def document_shards(spark: SparkSession, docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, lang, source, size, text_crc32, curve, shard, slot) of documents along (lang, source, size).

    A null text counts as no bytes, a null lang or source as an empty one.
    Repeated rows each get a slot of their own; so do rows with a null doc_id,
    which come before the others of their cell.  Other columns are not read.
    """
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", (F.octet_length(raw) + 16).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    sized = Scratch(spark, "sized").save(sized, "sized")
    return hilbert_shards(spark, sized, ["lang", "source", "size"], ["doc_id", "text_crc32", "size"], shards)
