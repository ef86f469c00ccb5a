"""Reads through cache tiers, write strategies and invalidation, as sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cache

TIER_SCHEMA = "key string, value string, expire_at bigint"
WRITE_THROUGH, WRITE_BACK = "write_through", "write_back"


def no_tier(spark) -> DataFrame:
    """A tier that always misses."""
    return spark.createDataFrame([], TIER_SCHEMA)


def tiered_read(requests: DataFrame, now: int, hot: DataFrame, main: DataFrame, l3: DataFrame, source: DataFrame, client: DataFrame | None = None) -> DataFrame:
    """(key, value, tier) of requests (key, is_remote): the first tier that has a key serves it.

    The order is client, hot, main; then for a key that another node owns, that
    node ('peer', reading the source); else l3, then the source.  Entries of
    client, hot and main have expire_at (null: never).  A source row without a
    value serves '', and so do empty values; keys nowhere are 'miss'.
    """
    live = cache.live_lru(F.col("expire_at"), F.lit(now))
    tiers = [("hot", hot.where(live)), ("main", main.where(live))]
    if client is not None:
        tiers.insert(0, ("client", client.where(~(F.lit(now) > F.col("expire_at")))))
    found = requests
    for name, tier in tiers:
        found = found.join(tier.select("key", F.coalesce("value", F.lit("")).alias(name)), "key", "left")
    found = found.join(l3.select("key", F.coalesce("value", F.lit("")).alias("l3")), "key", "left")
    found = found.join(source.select("key", F.coalesce("value", F.lit("")).alias("source")), "key", "left")
    near = [name for name, _ in tiers]
    value, tier = None, None
    for name in near:
        hit = F.col(name).isNotNull()
        value = F.when(hit, F.col(name)) if value is None else value.when(hit, F.col(name))
        tier = F.when(hit, F.lit(name)) if tier is None else tier.when(hit, F.lit(name))
    remote = F.col("is_remote") & F.col("source").isNotNull()
    local = ~F.col("is_remote")
    value = value.when(remote, F.col("source")).when(local, F.coalesce("l3", "source"))
    tier = tier.when(remote, "peer").when(local & F.col("l3").isNotNull(), "l3").when(local & F.col("source").isNotNull(), "source").otherwise("miss")
    return found.select("key", value.alias("value"), tier.alias("tier"))


def write_states(writes: DataFrame, as_of: int, lag: int) -> DataFrame:
    """Cache and durable value of each key at ``as_of``, from writes (key, value, strategy, at, tie).

    The cache has every write at once.  The source has write-through writes at
    once and write-back writes after ``lag``.  Another strategy is an error.
    """
    strategy = F.col("strategy")
    known = writes.withColumn(
        "strategy", F.when(strategy.isin(WRITE_THROUGH, WRITE_BACK), strategy).otherwise(F.raise_error(F.lit("unknown write strategy")))
    )
    durable_at = F.when(F.col("strategy") == WRITE_THROUGH, F.col("at")).otherwise(F.col("at") + lag)
    in_cache, durable = F.col("at") <= as_of, durable_at <= as_of
    return (
        known.withColumn("_durable_at", durable_at)
        .groupBy("key")
        .agg(
            F.max_by(F.when(in_cache, F.col("value")), F.when(in_cache, F.struct("at", "tie"))).alias("cached"),
            F.max_by(F.when(durable, F.col("value")), F.when(durable, F.struct("_durable_at", "tie"))).alias("durable"),
        )
        .where("cached IS NOT NULL")
    )


def surviving(loads: DataFrame, invalidations: DataFrame) -> DataFrame:
    """Loads (key, value, at) that no invalidation (key, at) of the same key at or after them has removed."""
    last = invalidations.groupBy("key").agg(F.max("at").alias("_gone"))
    return loads.join(last, "key", "left").where("_gone IS NULL OR _gone < at").drop("_gone")


def fan_out(keys: DataFrame, peers: DataFrame, own: str, transport: str) -> DataFrame:
    """(key, node) removals that are sent: to every peer, over HTTP without the own node.

    Peers are a cluster's nodes; each key becomes one row a node by definition.
    """
    nodes = peers.select("node") if transport == "grpc" else peers.select("node").where(F.col("node") != own)
    listed = nodes.agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return keys.select("key").join(F.broadcast(listed)).select("key", F.explode("nodes").alias("node"))
