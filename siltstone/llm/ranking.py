"""Row numbers over a total order without a single-task window.

Rows are range-sorted, each task numbers its own rows, and the counts of tasks
(one row a shuffle partition) give the offsets.  The numbered rows are written
to the shared folder, so a retried task cannot change what others have counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(seen, seen + n, dtype=np.int64))],
            [*batch.schema.names, "_part", "_index"],
        )
        seen += n


def with_rank(spark: SparkSession, df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """``df`` with the column rank, from 0 and without gaps, and the number of rows.

    Rows equal in the whole order are numbered in any order.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = scratch.save(dealt.mapInArrow(_number, f"{schema}, _part bigint, _index bigint"), name)
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for part, n in counts:
        starts.append((part, before))
        before += n
    first = spark.createDataFrame(starts or [(0, 0)], "_part bigint, _before bigint")
    ranked = placed.join(F.broadcast(first), "_part").withColumn("rank", F.col("_before") + F.col("_index"))
    return ranked.drop("_part", "_index", "_before"), before
