"""Consistent hashing with virtual nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import crc32

REPLICAS = 50
BUCKET_BITS = 20  # of 32: an arc is looked up by the upper 12 bits of a hash
SPACE = 1 << 32


def ring_points(nodes: DataFrame, replicas: int = REPLICAS, hash_of: Callable[[Column], Column] = crc32) -> DataFrame:
    """(h, node) of nodes (node, added): labels are the copy's number, then the node.

    Where two labels collide the node added last owns the point.
    """
    labels = nodes.select("node", "added", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("i"))
    hashed = labels.select(hash_of(F.concat(F.col("i").cast("string"), "node")).cast("bigint").alias("h"), "node", "added", "i")
    return hashed.groupBy("h").agg(F.max_by("node", F.struct("added", "i")).alias("node"))


def ring_arcs(points: DataFrame) -> DataFrame:
    """(lo, hi, node): the node owns hashes in (lo, hi]; what lies past the last point is the first node's.

    The window is over ring points, which are nodes times copies.
    """
    order = Window.orderBy("h")
    arcs = points.select(F.coalesce(F.lag("h").over(order), F.lit(-1)).alias("lo"), F.col("h").alias("hi"), "node")
    ends = points.agg(F.max("h").alias("lo"), F.min_by("node", "h").alias("node")).where("lo IS NOT NULL")
    return arcs.unionByName(ends.select("lo", F.lit(SPACE - 1).cast("bigint").alias("hi"), "node")).where("hi > lo")


def owners(keys: DataFrame, points: DataFrame, hash_of: Callable[[Column], Column] = crc32, name: str = "owner") -> DataFrame:
    """``keys`` (key) with the column ``name``, their owner; null on an empty ring.

    Arcs are spread over the buckets of the hash space that they touch, so the
    lookup is an equi-join whose small side is bounded by points and buckets.
    """
    spread = ring_arcs(points).select(
        "lo", "hi", "node", F.explode(F.sequence(F.shiftright(F.col("lo") + 1, BUCKET_BITS), F.shiftright("hi", BUCKET_BITS))).alias("bucket")
    )
    hashed = keys.withColumn("_h", hash_of(F.col("key")).cast("bigint")).withColumn("bucket", F.shiftright("_h", BUCKET_BITS))
    joined = hashed.join(spread, (hashed["bucket"] == spread["bucket"]) & (F.col("_h") > F.col("lo")) & (F.col("_h") <= F.col("hi")), "left")
    return joined.select(*[hashed[c] for c in keys.columns], F.col("node").alias(name))


def moved(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose owner differs between two rings: (key, old_owner, new_owner), a row for each row of ``keys``.

    Both owners are looked up in one pass over the keys.
    """
    both = owners(owners(keys.select("key"), before, name="old_owner"), after, name="new_owner")
    return both.where(~F.col("old_owner").eqNullSafe(F.col("new_owner")))
