"""Named caches over a source: options, registry, bounded tiers, reads that fill them, writes and removals.

Every call returns results and leaves its changes in the tiers.  Time is an
argument, never the clock; among the keys of one call the order is that of keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing
from .operators import cache, ring, tiers
from .session import Folder, settled
from .streaming.topic import Topic

Getter = Callable[[DataFrame], DataFrame]  # keys (key) -> the rows (key, value) that exist
Setter = Callable[[DataFrame], None]  # takes (key, value)

_groups: dict[str, Group] = {}

CHANGES = "key string, value string, expire_at bigint, op string, call bigint, at bigint"
MOST_PARTS = 16


class Tier:
    """Entries (key, value, expire_at) as changes appended to the shared folder: put, use and drop.

    A call writes what it changes; after MOST_PARTS writes they are merged into
    one, and what had been merged before is deleted.  With a capacity in bytes,
    each of 256 shards keeps its most recently used entries that fit together;
    those that go are handed to ``on_evicted`` as (key, value).
    """

    def __init__(self, spark: SparkSession, capacity: int | None = None, on_evicted: Setter | None = None):
        self.spark, self.on_evicted = spark, on_evicted
        self.shard_bytes = None if capacity is None else cache.shard_capacity(capacity)
        self.folder, self.calls, self.merged = Folder(spark, "tier"), 0, []
        self.parts: list[str] = []

    def entries(self) -> DataFrame:
        """(key, value, expire_at, used) of what is there, expired or not; used is (call, position, key)."""
        if not self.parts:
            return self.spark.createDataFrame([], f"{tiers.TIER_SCHEMA}, used struct<call:bigint,at:bigint,key:string>")
        changes = self.spark.read.schema(CHANGES).parquet(*self.parts)
        seq = F.struct("call", "at")
        last = changes.groupBy("key").agg(
            F.max_by(F.struct("op", "value", "expire_at"), F.when(F.col("op") != "use", seq)).alias("last"), F.max(seq).alias("used")
        )
        used = F.struct("used.call", "used.at", "key").alias("used")
        return last.where("last.op = 'put'").select("key", "last.value", "last.expire_at", used)

    def view(self) -> DataFrame:
        return self.entries().drop("used")

    def _append(self, rows: DataFrame, op: str) -> None:
        """Changes of one call; of rows (key, value, expire_at) that share a key the last counts."""
        self.calls += 1
        names = rows.columns
        of = lambda c, kind: (F.col(c) if c in names else F.lit(None)).cast(kind).alias(c)
        rows = rows.select("key", of("value", "string"), of("expire_at", "bigint"), of("at", "bigint"))
        rows = rows.withColumns({"op": F.lit(op), "call": F.lit(self.calls).cast("bigint"), "at": F.coalesce("at", F.lit(0)).cast("bigint")})
        self.parts.append(self.folder.save(rows, f"{self.calls}-{op}"))
        if len(self.parts) > MOST_PARTS:
            kept = self.entries().select("key", "value", "expire_at", F.lit("put").alias("op"), "used.call", "used.at")
            whole = self.folder.save(kept, f"{self.calls}-whole")
            self.folder.drop(*self.merged)
            self.merged, self.parts = self.parts, [whole]

    def put(self, rows: DataFrame) -> None:
        """Add or replace (key, value, expire_at) rows in their order, then drop what no longer fits."""
        numbered = rows.select("key", "value", "expire_at", F.monotonically_increasing_id().alias("_n"))
        last = numbered.groupBy("key").agg(F.max_by(F.struct("value", "expire_at"), "_n").alias("last"), F.max("_n").alias("at"))
        self._append(last.select("key", "last.value", "last.expire_at", "at"), "put")
        if self.shard_bytes is None:
            return
        sized = self.entries().select(
            "key", "value", F.col("used").alias("seq"), hashing.shard_of(F.col("key")).alias("shard"),
            (hashing.octets(F.col("key")) + F.coalesce(hashing.octets(F.col("value")), F.lit(0))).alias("nbytes"),
        )
        gone = settled(cache.lru_overflow(sized, self.shard_bytes).select("key", "value"))
        if not gone.isEmpty():
            self._append(gone.select("key"), "drop")
            if self.on_evicted is not None:
                self.on_evicted(gone)

    def use(self, keys: DataFrame) -> None:
        """Make keys the most recent ones; without a capacity recency is not kept."""
        if self.shard_bytes is not None:
            self._append(keys.select("key"), "use")

    def drop(self, keys: DataFrame) -> None:
        self._append(keys.select("key").distinct(), "drop")

    def purge(self, now: int) -> None:
        """Drop all that expired before ``now``."""
        self.drop(self.view().where(~cache.live_lru(F.col("expire_at"), F.lit(now))))


@dataclass(frozen=True)
class GroupOptions:
    """Milliseconds that entries live; 0 is for ever.  ``own`` names this node on its ring.

    ``cache_bytes`` bounds the main tier, an eighth of it the hot tier; None is no bound.
    """

    main_ttl: int = 0
    hot_ttl: int = 5000
    own: str = ""
    replicas: int = ring.REPLICAS
    cache_bytes: int | None = None


@dataclass
class Group:
    spark: SparkSession
    name: str
    getter: Getter
    options: GroupOptions = field(default_factory=GroupOptions)
    setter: Setter | None = None
    on_evicted: Setter | None = None
    points: DataFrame | None = None
    peers: dict[str, Group] = field(default_factory=dict)
    topic: Topic | None = None

    def __post_init__(self) -> None:
        limit = self.options.cache_bytes
        self.main_tier = Tier(self.spark, limit, self.on_evicted)
        self.hot_tier = Tier(self.spark, None if limit is None else cache.hot_capacity(limit), self.on_evicted)
        self.l3_tier = Tier(self.spark)

    main = property(lambda self: self.main_tier.view())
    hot = property(lambda self: self.hot_tier.view())
    l3 = property(lambda self: self.l3_tier.view().drop("expire_at"))

    def register_peers(self, nodes: DataFrame, peers: dict[str, Group] | None = None) -> None:
        """Nodes (node, added) of the ring, and the groups of those that can be asked; a second call is an error.

        A key of a node that can't be asked is read from the source, as its owner would.
        """
        if self.points is not None:
            raise ValueError("peers are registered already")
        self.points, self.peers = settled(ring.ring_points(nodes, self.options.replicas)), dict(peers or {})

    def register_mq(self, topic: Topic, checkpoint: str):
        """Publish removals and writes to a topic, and drop what is published there; returns the running query."""
        self.topic = topic
        return topic.subscribe(lambda keys, _: self.remove_local(keys), checkpoint)

    def owned(self, keys: DataFrame) -> DataFrame:
        """(key, is_remote, owner): whether another node owns a key, and which."""
        if self.points is None:
            return keys.select("key", F.lit(False).alias("is_remote"), F.lit(None).cast("string").alias("owner"))
        remote = F.col("owner").isNotNull() & (F.col("owner") != F.lit(self.options.own))
        return ring.owners(keys.select("key"), self.points).select("key", remote.alias("is_remote"), "owner")

    def get(self, keys: DataFrame, now: int) -> DataFrame:
        """(key, value, tier) of each distinct key; loads fill hot (from peers), or l3 and main (local).

        The source is asked once a key, for those that no tier serves.  Peers are
        asked through their own tiers; a key that its owner lacks is tried here.
        """
        if keys.where("key IS NULL OR key = ''").take(1):
            raise ValueError("keys may not be empty")
        requests = settled(self.owned(keys.select("key").distinct()))
        none = tiers.no_tier(self.spark).drop("expire_at")
        near = requests.select("key", F.col("is_remote"))
        held = settled(tiers.tiered_read(near, now, self.hot, self.main, self.l3, none).where("tier <> 'miss'"))
        self.main_tier.use(held.where("tier = 'main'"))
        self.hot_tier.use(held.where("tier = 'hot'"))
        asked = requests.join(held, "key", "left_anti")
        answers = []
        for node, peer in self.peers.items():  # nodes of a cluster
            theirs = settled(asked.where(F.col("is_remote") & (F.col("owner") == F.lit(node))).select("key"))
            if not theirs.isEmpty():
                answers.append(peer.get(theirs, now).where("tier <> 'miss'").select("key", "value", F.lit("peer").alias("tier")))
        for answer in answers:
            asked = asked.join(answer, "key", "left_anti")
        asked = settled(asked)
        loaded = self._distinct(self.getter(asked.select("key"))).select("key", F.coalesce("value", F.lit("")).alias("value"))
        by_peer = F.col("is_remote") & ~F.coalesce(F.col("owner").isin(list(self.peers)), F.lit(False))
        fresh = asked.join(loaded, "key").select("key", "value", F.when(by_peer, "peer").otherwise("source").alias("tier"))
        for answer in answers:
            fresh = fresh.unionByName(answer)
        fresh = settled(fresh)
        expire = lambda ttl: cache.expiry(F.lit(now).cast("bigint"), ttl)
        in_order = lambda rows: rows.orderBy("key")
        self.hot_tier.put(in_order(fresh.where("tier = 'peer'").select("key", "value", expire(self.options.hot_ttl).alias("expire_at"))))
        local = fresh.where("tier = 'source'").select("key", "value")
        self.l3_tier.put(local.withColumn("expire_at", F.lit(None).cast("bigint")))
        back = local.unionByName(held.where("tier = 'l3'").select("key", "value"))
        self.main_tier.put(in_order(back.select("key", "value", expire(self.options.main_ttl).alias("expire_at"))))
        absent = asked.join(fresh, "key", "left_anti").select("key", F.lit(None).cast("string").alias("value"), F.lit("miss").alias("tier"))
        return held.unionByName(fresh).unionByName(absent)

    def set(self, rows: DataFrame, now: int, strategy: str = tiers.WRITE_THROUGH) -> Callable[[], None]:
        """Write (key, value) rows; returns what is still to do, which write-back leaves for later.

        Of rows that share a key the last one counts.  Hot entries stay as they
        are until they expire.  Errors of the setter reach the caller before
        anything is cached if writing through.  Keys are published once durable.
        """
        if self.setter is None:
            raise ValueError("the group has no setter")
        if strategy not in (tiers.WRITE_THROUGH, tiers.WRITE_BACK):
            raise ValueError(f"unknown write strategy {strategy!r}")
        rows = settled(self._distinct(rows))
        never = F.lit(None).cast("bigint")

        def durable() -> None:
            self.setter(rows)
            self.l3_tier.put(rows.withColumn("expire_at", never))

        def publish() -> None:
            if self.topic is not None:
                self.topic.publish(rows)

        def later() -> None:
            durable()
            publish()

        if strategy == tiers.WRITE_THROUGH:
            durable()
        self.main_tier.put(rows.orderBy("key").withColumn("expire_at", cache.expiry(F.lit(now).cast("bigint"), self.options.main_ttl)))
        if strategy == tiers.WRITE_THROUGH:
            publish()
            return lambda: None
        return later

    def purge(self, now: int) -> None:
        """Drop expired entries of both tiers: what a periodic cleanup calls."""
        self.main_tier.purge(now)
        self.hot_tier.purge(now)

    def remove_local(self, keys: DataFrame) -> None:
        """What a node does on an invalidation."""
        self.main_tier.drop(keys)
        self.hot_tier.drop(keys)

    def remove(self, keys: DataFrame, publish: Setter | None = None, transport: str = "grpc") -> DataFrame | None:
        """Drop keys here and in l3, then publish them, or else return the (key, node) removals to send; the source keeps them.

        Peers that can be asked drop them at once.
        """
        self.remove_local(keys)
        self.l3_tier.drop(keys)
        publish = publish or (self.topic.publish if self.topic is not None else None)
        if publish is not None:
            publish(keys)
            return None
        for node, peer in self.peers.items():
            if node != self.options.own:
                peer.remove_local(keys)
        if self.points is None:
            return None
        return tiers.fan_out(keys, self.points.select("node").distinct(), self.options.own, transport)

    @staticmethod
    def _distinct(rows: DataFrame) -> DataFrame:
        """(key, value), the last row of each key."""
        numbered = rows.select("key", "value", F.monotonically_increasing_id().alias("_n"))
        return numbered.groupBy("key").agg(F.max_by("value", "_n").alias("value"))


class Client:
    """A cache in front of a group that fills itself; entries live ``ttl`` milliseconds, their last instant included.

    Nobody tells it of removals, as is its nature: what it holds may be old by its ttl.
    """

    def __init__(self, group: Group, ttl: int):
        self.group, self.ttl = group, ttl
        self.tier = Tier(group.spark)

    def get(self, keys: DataFrame, now: int) -> DataFrame:
        """(key, value, tier) of each distinct key; tier is 'client' for what is served here."""
        wanted = settled(keys.select("key").distinct())
        live = self.tier.view().where(~(F.lit(now) > F.col("expire_at")))
        held = settled(live.join(wanted, "key", "left_semi").select("key", "value", F.lit("client").alias("tier")))
        found = settled(self.group.get(wanted.join(held, "key", "left_anti"), now))
        fresh = found.where("tier <> 'miss'")
        self.tier.put(fresh.select("key", "value", cache.expiry(F.lit(now).cast("bigint"), self.ttl, client=True).alias("expire_at")))
        return held.unionByName(found)


def new_group(
    spark: SparkSession, name: str, getter: Getter, options: GroupOptions = GroupOptions(), setter: Setter | None = None, on_evicted: Setter | None = None
) -> Group:
    """Make and register a group; one of the same name is replaced."""
    _groups[name] = Group(spark, name, getter, options, setter, on_evicted)
    return _groups[name]


def get_group(name: str) -> Group | None:
    return _groups.get(name)
