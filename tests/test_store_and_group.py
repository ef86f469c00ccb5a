"""The table store and the groups of caches, as a user meets them."""

import pytest
from pyspark.sql import functions as F

from siltstone import group as groups
from siltstone.functions import hashing
from siltstone.operators import tiers
from siltstone.store import LogStore

KV = "key string, value string"


def kv(spark, rows):
    return spark.createDataFrame(rows, KV)


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def pairs(df):
    return {tuple(r) for r in df.select("key", "value").collect()}


def test_store_put_delete_recover(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/db")
    assert store.scan().count() == 0 and store.flush() is None
    store.put(kv(spark, [("key1", "value1"), ("key2", "value2")]))
    store.delete(keys(spark, "key1"))
    assert pairs(store.get(keys(spark, "key1", "key2", "nokey"))) == {("key2", "value2")}
    again = LogStore(spark, f"file://{tmp_path}/db")
    assert pairs(again.scan()) == {("key2", "value2")}
    assert again.flush() == 1 and pairs(again.scan()) == {("key2", "value2")}
    assert {tuple(r) for r in again.manifest().select("file_no", "smallest", "largest", "num_entries", "next_file_no").collect()} == {(1, "key1", "key2", 2, 2)}


def test_store_flushes_when_full_and_keeps_order(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/db", flush_bytes=1000)
    store.put(spark.range(40).select(F.format_string("key%02d", "id").alias("key"), F.lit("a" * 50).alias("value")))
    store.put(kv(spark, [("key00", "new")]))
    assert store.files().select("file_no").distinct().count() == 1
    assert [tuple(r) for r in store.seek("key00", 2).collect()] == [("key00", "new"), ("key01", "a" * 50)]
    store.write_batch(spark.createDataFrame([("key00", "put", "x"), ("key01", "delete", None)], "key string, op string, value string"))
    assert pairs(store.get(keys(spark, "key00", "key01"))) == {("key00", "x")}
    assert pairs(store.get(keys(spark, "key00", "key01"), strict=False)) == {("key00", "x"), ("key01", "a" * 50)}
    store.flush()
    assert pairs(store.get(keys(spark, "key00", "key01"), strict=False)) == {("key00", "x")}


def test_store_of_bytes_and_its_versions(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/db", kind="binary")
    rows = lambda *r: spark.createDataFrame([tuple(map(bytearray, x)) for x in r], "key binary, value binary")
    assert store.version().count() == 0
    store.put(rows((b"\xff\x00", b"\xfe"), (b"a", b"")))
    assert store.flush() == 1
    store.delete(rows((b"a", b"")).select("key"))
    store.put(rows((b"\x00", b"\xff")))
    assert store.flush() == 2
    assert [(bytes(r.key), bytes(r.value)) for r in store.scan().collect()] == [(b"\x00", b"\xff"), (b"\xff\x00", b"\xfe")]
    assert [(bytes(r.key)) for r in store.seek(b"\x01", 5).collect()] == [b"\xff\x00"]
    for n in (1, 2):
        got = {(r.file_no, bytes(r.smallest), bytes(r.largest), r.num_entries, r.next_file_no) for r in store.version(n).collect()}
        assert got == {(1, b"a", b"\xff\x00", 2, n + 1), *({(2, b"\x00", b"a", 2, 3)} if n == 2 else ())}
    assert {tuple(r) for r in store.version().select("file_no", "data_bytes").collect()} == {tuple(r) for r in store.manifest().select("file_no", "data_bytes").collect()}


SCORES = [("Tom", "630"), ("Jack", "589"), ("Sam", "567"), ("Nil", None)]


@pytest.fixture
def scores(spark):
    """A group whose source counts what it is asked for."""
    source, asked = dict(SCORES), []

    def getter(wanted):
        names = [r.key for r in wanted.collect()]
        asked.extend(names)
        return spark.createDataFrame([(n, source[n]) for n in names if n in source], KV)

    def setter(rows):
        source.update({r.key: r.value for r in rows.collect()})

    group = groups.new_group(spark, "scores", getter, groups.GroupOptions(main_ttl=1000), setter)
    group.asked, group.source = asked, source
    return group


def test_group_loads_once(spark, scores):
    assert groups.get_group("scores") is scores and groups.get_group("none") is None
    first = {r.key: (r.value, r.tier) for r in scores.get(keys(spark, "Tom", "Tom", "Nil", "unknown"), 0).collect()}
    assert first == {"Tom": ("630", "source"), "Nil": ("", "source"), "unknown": (None, "miss")}
    second = {r.key: (r.value, r.tier) for r in scores.get(keys(spark, "Tom", "Nil"), 1000).collect()}
    assert second == {"Tom": ("630", "main"), "Nil": ("", "main")}
    assert sorted(scores.asked) == ["Nil", "Tom", "unknown"]
    assert {r.tier for r in scores.get(keys(spark, "Tom"), 1001).collect()} == {"l3"}
    with pytest.raises(ValueError):
        scores.get(keys(spark, ""), 0)


def test_group_writes(spark, scores):
    scores.set(kv(spark, [("key1", "val1")]), 0)
    assert scores.source["key1"] == "val1"
    later = scores.set(kv(spark, [("key2", "val2")]), 0, tiers.WRITE_BACK)
    assert "key2" not in scores.source and {r.value for r in scores.get(keys(spark, "key2"), 0).collect()} == {"val2"}
    later()
    assert scores.source["key2"] == "val2"
    with pytest.raises(ValueError):
        scores.set(kv(spark, []), 0, "other")


def test_group_remove_and_peers(spark, scores):
    scores.get(keys(spark, "Tom"), 0)
    published = []
    scores.remove(keys(spark, "Tom"), publish=lambda k: published.extend(r.key for r in k.collect()))
    assert published == ["Tom"] and scores.main.count() == scores.l3.count() == 0
    assert {r.tier for r in scores.get(keys(spark, "Tom"), 1).collect()} == {"source"}
    nodes = spark.createDataFrame([("p1", 0), ("p2", 1)], "node string, added int")
    scores.register_peers(nodes)
    with pytest.raises(ValueError):
        scores.register_peers(nodes)
    assert {tuple(r) for r in scores.remove(keys(spark, "Tom")).collect()} == {("Tom", "p1"), ("Tom", "p2")}
    tiers_ = {r.key: r.tier for r in scores.get(keys(spark, "Tom", "Jack", "Sam"), 1).collect()}
    assert set(tiers_.values()) == {"peer"}  # this node isn't on the ring
    assert {r.tier for r in scores.get(keys(spark, "Tom"), 5001).collect()} == {"hot"}
    assert {r.tier for r in scores.get(keys(spark, "Tom"), 5002).collect()} == {"peer"}


def test_repeated_keys_keep_the_last(spark, scores):
    scores.set(kv(spark, [("k", "1"), ("k", "2"), ("k", "3")]).coalesce(1), 0)
    assert [(r.value, r.tier) for r in scores.get(keys(spark, "k"), 0).collect()] == [("3", "main")]
    assert scores.source["k"] == "3" and scores.main.count() == scores.l3.count() == 1


def test_bounded_group_against_a_sequential_lru(spark):
    """Random reads, writes and removals in calls of a few keys; what stays is what an LRU a shard keeps."""
    import random
    from collections import OrderedDict

    from siltstone.operators import cache

    rng, gone = random.Random(3), []
    near = spark.range(4000).select(F.format_string("k%04d", "id").alias("key")).where(hashing.shard_of(F.col("key")) < 2).limit(24)
    source = {r.key: "v" * (n % 6) for n, r in enumerate(near.collect())}  # in two shards
    getter = lambda wanted: spark.createDataFrame([(r.key, source[r.key]) for r in wanted.collect()], KV)
    group = groups.Group(spark, "g", getter, groups.GroupOptions(cache_bytes=256 * 12), on_evicted=lambda rows: gone.extend(r.key for r in rows.collect()))
    limit, shards, dropped = cache.shard_capacity(256 * 12), {}, []

    def shard(key):
        h = 2166136261
        for b in key.encode():
            h = (h ^ b) * 16777619 % 2**32
        return shards.setdefault(h % 256, OrderedDict())

    for _ in range(4):
        some = sorted(rng.sample(sorted(source), 7))
        group.get(keys(spark, *some), 0)
        hit = [k for k in some if k in shard(k)]
        for k in hit:
            shard(k).move_to_end(k)
        for k in (k for k in some if k not in hit):
            held = shard(k)
            held[k] = len(k) + len(source[k])
            while sum(held.values()) > limit:
                dropped.append(held.popitem(last=False)[0])
        out = rng.choice(sorted(source))
        group.remove(keys(spark, out))
        shard(out).pop(out, None)
    assert {r.key for r in group.main.collect()} == {k for held in shards.values() for k in held}
    assert sorted(gone) == sorted(dropped) and dropped


def test_tiers_merge_their_changes(spark, monkeypatch):
    monkeypatch.setattr(groups, "MOST_PARTS", 3)
    tier = groups.Tier(spark)
    for n in range(12):
        tier.put(kv(spark, [(f"k{n % 5}", str(n))]).withColumn("expire_at", F.lit(n).cast("bigint")))
        if n == 8:
            tier.drop(keys(spark, "k0"))
    assert pairs(tier.view()) == {("k0", "10"), ("k1", "11"), ("k2", "7"), ("k3", "8"), ("k4", "9")} and len(tier.parts) <= 4
    tier.purge(9)
    assert {r.key for r in tier.view().collect()} == {"k0", "k1", "k4"}


def test_client_in_front_of_a_group(spark, scores):
    client = groups.Client(scores, 100)
    first = {(r.value, r.tier) for r in client.get(keys(spark, "Tom"), 0).collect()}
    scores.remove(keys(spark, "Tom"), publish=lambda k: None)
    second = {(r.value, r.tier) for r in client.get(keys(spark, "Tom", "unknown"), 100).collect()}
    third = {(r.value, r.tier) for r in client.get(keys(spark, "Tom"), 101).collect()}
    assert (first, second, third) == ({("630", "source")}, {("630", "client"), (None, "miss")}, {("630", "source")})


def test_peers_read_through_their_own_tiers(spark):
    asked = []

    def group(own):
        def getter(wanted):
            names = [r.key for r in wanted.collect()]
            asked.extend((own, n) for n in names)
            return kv(spark, [(n, f"{own}:{n}") for n in names if n != "none"])

        return groups.Group(spark, own, getter, groups.GroupOptions(own=own))

    one, two = group("p1"), group("p2")
    nodes = spark.createDataFrame([("p1", 0), ("p2", 1)], "node string, added int")
    one.register_peers(nodes, {"p2": two})
    two.register_peers(nodes, {"p1": one})
    names = [f"k{n}" for n in range(12)] + ["none"]
    owner = {r.key: r.owner for r in one.owned(keys(spark, *names)).collect()}
    assert set(owner.values()) == {"p1", "p2"}
    got = {r.key: (r.value, r.tier) for r in one.get(keys(spark, *names), 0).collect()}
    assert got["none"] == (None, "miss")
    assert all(got[n] == (f"{owner[n]}:{n}", "source" if owner[n] == "p1" else "peer") for n in names[:-1])
    assert {r.key for r in two.main.collect()} == {n for n in names[:-1] if owner[n] == "p2"}
    asked.clear()
    assert {r.tier for r in one.get(keys(spark, *names[:-1]), 5001).collect()} == {"main", "peer"} and not asked
    one.remove(keys(spark, *names))
    assert two.main.count() == 0


def test_invalidation_by_a_topic(spark, tmp_path):
    from siltstone.streaming.topic import Topic

    source = {"Tom": "1"}
    getter = lambda wanted: kv(spark, [(r.key, source[r.key]) for r in wanted.collect() if r.key in source])
    one, two = (groups.Group(spark, n, getter, setter=lambda rows: source.update({r.key: r.value for r in rows.collect()})) for n in ("one", "two"))
    topic = Topic(spark, f"file://{tmp_path}/topic")
    running = [g.register_mq(topic, f"file://{tmp_path}/c{k}") for k, g in enumerate((one, two))]
    two.get(keys(spark, "Tom"), 0)
    one.set(kv(spark, [("Tom", "2")]), 0)
    for q in running:
        q.processAllAvailable()
    assert two.main.count() == 0 and {r.value for r in two.get(keys(spark, "Tom"), 0).collect()} == {"1"}  # l3 is its own here
    assert one.remove(keys(spark, "Tom")) is None
    for q in running:
        q.processAllAvailable()
        q.stop()
    assert two.main.count() == 0
