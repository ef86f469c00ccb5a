"""Connected components by alternating large-star and small-star.

Every step is two equi-joins on written tables, so a node with very many
neighbours is a skewed key that adaptive execution splits, not one large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, keep: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b), written to ``keep``; component is the least node reachable.

    Loops, repeated edges and nulls are dropped.  Rounds grow with the logarithm
    of the largest component; more than ``max_rounds`` is an error.
    """
    scratch = Scratch(spark, "components")
    pair = lambda x, y: [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]
    now = scratch.save(edges.where("a <> b").select(*pair("a", "b")).distinct(), "e0")
    state = _fingerprint(now)
    for k in range(max_rounds):
        large = _large_star(scratch, now, f"m{k}")
        small = _small_star(scratch, large, f"l{k}", f"n{k}")
        after = scratch.save(small, f"e{k + 1}")
        scratch.drop(f"e{k}", f"m{k}", f"l{k}", f"n{k}")
        now, before, state = after, state, _fingerprint(after)
        if state == before:
            break
    else:
        raise RuntimeError("components have not settled")
    # Now every edge points at the least node of its component.
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    labels = keep.save(labels, name)
    scratch.close()
    return labels


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def _large_star(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """For each node, join its greater neighbours to the least of its neighbourhood."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = scratch.save(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), name)
    return both.join(least, "x").where("y > x AND y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(scratch: Scratch, edges: DataFrame, held: str, name: str) -> DataFrame:
    """For each node, join its lesser neighbours and itself to the least of them."""
    edges = scratch.save(edges, held)
    least = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
