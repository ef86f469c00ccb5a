"""Small literal cases, and state machines against plain Python."""

import binascii
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from siltstone.functions import hashing
from siltstone.operators import cache, kvlog, ring, routes, sst, tiers

LOG = "seq bigint, op string, key string, value string, file_no int"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_put_delete_latest_wins(spark):
    log = spark.createDataFrame([(1, "put", "key1", "value1", 1), (2, "put", "key2", "value2", 1), (3, "delete", "key1", "", 2), (4, "delete", "key3", "", 2)], LOG)
    assert pairs(kvlog.snapshot(log)) == {("key2", "value2")}
    assert pairs(kvlog.point_get(log, "key1")) == set()
    assert pairs(kvlog.point_get(log, "key2")) == {("key2", "value2")}
    probes = spark.createDataFrame([("key1",), ("key2",), ("nokey",)], "key string")
    assert {(r.key, r.code, r.file_no) for r in kvlog.merge_get(log, probes).collect()} == {("key1", 2, 2), ("key2", 1, 1), ("nokey", 0, None)}


def test_wide_log(spark):
    log = spark.range(4000).select(F.col("id").alias("seq"), F.lit("put").alias("op"), F.format_string("key_%d_%d", F.col("id") % 4, (F.col("id") / 4).cast("int")).alias("key"), F.col("id").cast("string").alias("value"), F.lit(1).alias("file_no"))
    assert kvlog.snapshot(log).count() == 4000
    assert [r.key for r in kvlog.seek(log, "key_3_99", 2).collect()] == ["key_3_99", "key_3_990"]


def test_unflushed_tombstone_strict_and_not(spark):
    log = spark.createDataFrame([(1, "put", "k", "old", 1), (2, "delete", "k", "", 2), (3, "put", "j", "new", 2), (4, "delete", "i", "", 1)], LOG)
    assert pairs(kvlog.live_reads(log)) == {("j", "new")}
    assert pairs(kvlog.live_reads(log, strict=False)) == {("j", "new"), ("k", "old")}


def test_same_key_in_three_files_and_empty_value(spark):
    log = spark.createDataFrame([(1, "put", "k", "a", 1), (2, "put", "k", "b", 2), (3, "put", "k", "", 3)], LOG)
    assert pairs(kvlog.snapshot(log)) == {("k", "")}
    assert kvlog.raw_scan(log).count() == 3


def test_torn_tail(spark):
    log = spark.createDataFrame([(1, "put", "key1", "value1", 1), (2, "put", "key2", "value2", 1), (3, "delete", "key1", "x", 1)], LOG)
    offsets = sst.wal_offsets(log)
    assert [(r.start_offset, r.end_offset) for r in offsets.orderBy("seq").collect()] == [(0, 19), (19, 38), (38, 51)]
    assert sst.truncate_torn(offsets, 38).count() == 2
    assert sst.truncate_torn(offsets, 37).count() == 1


def test_hashes(spark):
    words = ["", "a", "foobar", "Ünï", "key_1"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.fnv1a32(F.col("w")).alias("f"), hashing.crc32(F.col("w")).alias("c")).collect()
    for r in got:
        h = 2166136261
        for b in r.w.encode():
            h = (h ^ b) * 16777619 % (1 << 32)
        assert (r.f, r.c) == (h, binascii.crc32(r.w.encode()))


def test_ring_with_numbers(spark):
    as_number = lambda c: c.cast("bigint")
    nodes = spark.createDataFrame([("6", 0), ("4", 1), ("2", 2)], "node string, added int")
    points = ring.ring_points(nodes, 3, as_number)
    assert sorted(r.h for r in points.collect()) == [2, 4, 6, 12, 14, 16, 22, 24, 26]
    keys = spark.createDataFrame([("2",), ("11",), ("23",), ("27",)], "key string")
    assert pairs(ring.owners(keys, points, as_number)) == {("2", "2"), ("11", "2"), ("23", "4"), ("27", "2")}
    more = ring.ring_points(nodes.unionByName(spark.createDataFrame([("8", 3)], nodes.schema)), 3, as_number)
    assert pairs(ring.owners(keys, more, as_number)) == {("2", "2"), ("11", "2"), ("23", "4"), ("27", "8")}


def test_ring_collision_and_empty(spark):
    same = lambda c: F.lit(7).cast("bigint")
    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "node string, added int")
    assert pairs(ring.ring_points(nodes, 2, same)) == {(7, "b")}
    none = ring.ring_points(nodes.where("added > 9"))
    assert pairs(ring.owners(spark.createDataFrame([("x",)], "key string"), none)) == {("x", None)}


def lru(trace, capacity):
    held, used, out = OrderedDict(), 0, []
    for key, n in trace:
        if key in held:
            held.move_to_end(key)
            out.append(True)
            continue
        held[key] = n
        used += n
        while capacity and used > capacity:
            used -= held.popitem(last=False)[1]
        out.append(False)
    return out


@pytest.mark.parametrize("capacity", [0, 8, 30, 64])
def test_lru_like_a_list(spark, capacity):
    rng = random.Random(capacity)
    rows, expected = [], {}
    for shard in range(6):
        trace = [(f"k{rng.randrange(12)}", 0) for _ in range(80)]
        trace = [(k, 3 + int(k[1:])) for k, _ in trace]
        rows += [(shard, i, k, n) for i, (k, n) in enumerate(trace)]
        expected[shard] = lru(trace, capacity)
    got = cache.lru_hits_by(spark.createDataFrame(rows, "shard int, seq int, key string, nbytes bigint"), ["seq"], capacity).orderBy("shard", "seq").collect()
    assert [r.hit for r in got] == [h for s in range(6) for h in expected[s]]


def test_lru_eviction_keeps_a_suffix(spark):
    adds = spark.createDataFrame([(0, 1, "key1", 10), (0, 2, "k2", 4), (0, 3, "k3", 4), (0, 4, "k4", 4)], "shard int, seq int, key string, nbytes bigint")
    assert {r.key for r in cache.lru_contents(adds, 10).collect()} == {"k3", "k4"}
    assert {r.key for r in cache.lru_contents(adds, 3).collect()} == set()


OPS = "shard int, seq int, op string, key string, value string, ttl bigint, at bigint"


def done(spark, ops, capacity):
    rows = [(0, i, *op) for i, op in enumerate(ops)]
    return [r.done for r in cache.lru_machine(spark.createDataFrame(rows, OPS), capacity).orderBy("seq").collect()]


def test_machine_get_and_eviction_order(spark):
    adds = [("add", k, v, 0, 0) for k, v in (("key1", "123456"), ("k2", "k2"), ("k3", "k3"), ("k4", "k4"))]
    got = done(spark, adds, 10)
    assert [k for r in got for k in r.evicted] == ["key1", "k2"] and (got[-1]["items"], got[-1].bytes) == (2, 8)
    got = done(spark, [("add", "key1", "1234", 0, 0), ("get", "key1", None, None, 0), ("get", "key2", None, None, 0)], 0)
    assert [(r.hit, r.value) for r in got[1:]] == [(True, "1234"), (False, None)]


def test_machine_expiry_purge_remove_and_update(spark):
    got = done(spark, [("add", "key1", "v", 1000, 0), ("get", "key1", None, None, 1000), ("get", "key1", None, None, 2000)], 0)
    assert [r.hit for r in got[1:]] == [True, False] and got[2].evicted == ["key1"]
    got = done(spark, [("add", "key1", "v", 100, 0), ("add", "key2", "v", 3600000, 0), ("purge", None, None, None, 200), ("remove", "key2", None, None, 200), ("remove", "key2", None, None, 200)], 0)
    assert [r["items"] for r in got] == [1, 2, 1, 0, 0] and [r.evicted for r in got[2:]] == [["key1"], ["key2"], []]
    got = done(spark, [("add", "k", "v", 0, 0), ("add", "k", "vvvv", 0, 0), ("add", "big", "x" * 50, 0, 0)], 20)
    assert [r.bytes for r in got] == [2, 5, 0] and got[2].evicted == ["k", "big"]


def test_capacity_rules():
    assert cache.shard_capacity(0) == 1024 and cache.shard_capacity(255) == 1024
    assert cache.shard_capacity(2048) == 8 and cache.shard_capacity(cache.hot_capacity(2048)) == 1
    assert cache.shard_capacity(1024) == 4 and cache.shard_capacity(cache.hot_capacity(1024)) == 1024


def test_expiry_is_anchored_at_the_load(spark):
    access = spark.createDataFrame([("t", s, s) for s in (0, 1, 6, 10, 11, 12)], "key string, us bigint, tie bigint")
    assert pairs(cache.hits_and_misses(access, 10)) == {("t", 4, 2)}  # still live at its last instant
    assert pairs(cache.coalesced_calls(access, 10)) == {("t", 2, 4)}  # a call that ends then is over
    assert cache.hits_and_misses(access.limit(0), 10).count() == 0


def test_thousand_callers_load_once(spark):
    calls = spark.range(1000).select(F.lit("k").alias("key"), (F.col("id") % 50).alias("us"), F.col("id").alias("tie"))
    assert pairs(cache.coalesced_calls(calls, 100)) == {("k", 1, 999)}


def test_expiry_at_now_and_zero_ttl(spark):
    r = spark.range(1).select(
        cache.live_lru(F.lit(5), F.lit(5)).alias("at"), cache.live_lru(F.lit(4), F.lit(5)).alias("past"), cache.live_lru(cache.expiry(F.lit(1), 0), F.lit(99)).alias("never"),
        cache.expiry(F.lit(1), 0, client=True).alias("client"),
    ).first()
    assert tuple(r) == (True, False, True, 1)


def tier(spark, rows):
    return spark.createDataFrame(rows, tiers.TIER_SCHEMA)


def test_tiers_in_order(spark):
    source = tier(spark, [("a", "s", None), ("b", "s", None), ("c", "s", None), ("d", "s", None), ("n", None, None)])
    requests = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False), ("n", False), ("x", False), ("y", True)], "key string, is_remote boolean")
    got = tiers.tiered_read(requests, 10, tier(spark, [("a", "hot", 10)]), tier(spark, [("a", "main", None), ("b", "main", 9)]), tier(spark, [("b", "l3", None), ("c", "l3", None)]), source)
    assert {r.key: (r.value, r.tier) for r in got.collect()} == {
        "a": ("hot", "hot"), "b": ("l3", "l3"), "c": ("s", "peer"), "d": ("s", "source"), "n": ("", "source"), "x": (None, "miss"), "y": (None, "miss"),
    }
    client = tiers.tiered_read(requests, 10, tiers.no_tier(spark), tiers.no_tier(spark), tiers.no_tier(spark).drop("expire_at"), source, tier(spark, [("a", "c", 10), ("b", "c", 9)]))
    assert {r.key: r.tier for r in client.collect() if r.key in "ab"} == {"a": "client", "b": "source"}


def test_write_strategies(spark):
    writes = spark.createDataFrame([("k1", "v1", tiers.WRITE_THROUGH, 0, 0), ("k2", "v2", tiers.WRITE_BACK, 0, 1)], "key string, value string, strategy string, at bigint, tie bigint")
    assert pairs(tiers.write_states(writes, 0, 100)) == {("k1", "v1", "v1"), ("k2", "v2", None)}
    assert pairs(tiers.write_states(writes, 100, 100)) == {("k1", "v1", "v1"), ("k2", "v2", "v2")}
    with pytest.raises(Exception, match="unknown write strategy"):
        tiers.write_states(writes.withColumn("strategy", F.lit("other")), 0, 100).collect()


def test_invalidation_kills_what_was_loaded_by_then(spark):
    loads = spark.createDataFrame([("a", "1", 5), ("b", "2", 5), ("c", "3", 5)], "key string, value string, at bigint")
    gone = spark.createDataFrame([("a", 5), ("b", 4)], "key string, at bigint")
    assert {r.key for r in tiers.surviving(loads, gone).collect()} == {"b", "c"}


def test_fan_out(spark):
    keys, peers = spark.createDataFrame([("key1",)], "key string"), spark.createDataFrame([("p1",), ("p2",)], "node string")
    assert pairs(tiers.fan_out(keys, peers, "p1", "grpc")) == {("key1", "p1"), ("key1", "p2")}
    assert pairs(tiers.fan_out(keys, peers, "p1", "http")) == {("key1", "p2")}


def test_routes(spark):
    asked = [("GET", "/_cache/scores/Tom"), ("GET", "/_cache/scores/Nobody"), ("GET", "/x/scores/Tom"), ("GET", "/_cache/scores"), ("GET", "/_cache/none/Tom"), ("DELETE", "/_cache/scores/Nobody"), ("POST", "/_cache/scores/Tom"), ("GET", "/_cache/scores/"), ("GET", "/_cache/scores/a/b")]
    got = routes.route(
        spark.createDataFrame(asked, "method string, path string"), spark.createDataFrame([("scores",)], "group string"), spark.createDataFrame([("scores", "Tom"), ("scores", "a/b"), ("scores", "")], "group string, key string")
    )
    assert {(r.method, r.path): r.status for r in got.collect()} == dict(zip(asked, [200, 500, 400, 400, 404, 200, 200, 500, 200]))


def test_url_key(spark):
    assert spark.range(1).select(routes.url_key(F.lit("g"), F.lit("a b/c"))).first()[0] == "/_cache/g/a+b%2Fc"


def test_moved_keys_that_repeat(spark):
    keys = spark.createDataFrame([(f"k{n % 20}",) for n in range(60)], "key string")
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "node string, added int")
    before, after = ring.ring_points(nodes.where("added < 2")), ring.ring_points(nodes)
    old, new = ({r.key: r.owner for r in ring.owners(keys.distinct(), p).collect()} for p in (before, after))
    got = ring.moved(keys, before, after).collect()
    assert sorted((r.key, r.old_owner, r.new_owner) for r in got) == sorted((k, old[k], new[k]) for n in range(60) for k in [f"k{n % 20}"] if old[k] != new[k])


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("width", [0, 3, 50, 1 << 62])
def test_leaders_over_batches_like_a_loop(inclusive, width):
    import numpy as np

    rng = random.Random(width)
    rows = sorted((rng.choice("abcde"), rng.randrange(200)) for _ in range(400))
    expected, now, at = [], None, 0
    for key, us in rows:
        leads = key != now or (us > at + width if inclusive else us >= at + width)
        if leads:
            now, at = key, us
        expected.append(leads)
    for size in (1, 7, 400):
        got, key, anchor = [], None, None
        for k in range(0, len(rows), size):
            part = rows[k : k + size]
            first = np.array([i for i in range(len(part)) if i == 0 or part[i][0] != part[i - 1][0]])
            leads, last = cache.leaders(np.array([us for _, us in part]), first, width, inclusive, anchor if part[0][0] == key else None)
            got, key, anchor = got + leads.tolist(), part[-1][0], last
        assert got == expected


def test_hash_of_texts_beyond_one_byte(spark):
    texts = ["", "a", "part-7", "ключ", "a€𝔘", "\x7f\x80", "\x00"]

    def fnv(raw):
        h = 2166136261
        for b in raw:
            h = (h ^ b) * 16777619 % 2**32
        return h

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.fnv1a32(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [fnv(r.t.encode()) for r in got]


def test_a_key_of_the_event_log_is_a_predicate_on_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for key in ("user-7", "user-07", "user-x", "other", "user-"):
        got = kvlog.event_log(kvlog.user_events(events, key)).where(F.col("key") == key).count()
        assert got == kvlog.event_log(events).where(F.col("key") == key).count()
    plan = kvlog.point_get(kvlog.event_log(kvlog.user_events(events, "user-7")), "user-7")._jdf.queryExecution().toString()
    assert "EqualTo(user_id,7)" in plan


def test_files_by_probes_are_bounded(spark):
    files = spark.createDataFrame([(1, "a", "m"), (2, "k", "z"), (3, "p", "q")], "file_no int, smallest string, largest string")
    probes = spark.createDataFrame([("l",), ("p",), ("p",), ("zz",), (None,)], "key string")
    assert sorted(tuple(r) for r in sst.candidate_files(files, probes).collect()) == [("l", 1), ("l", 2), ("p", 2), ("p", 3)]
    with pytest.raises(Exception, match="more than 2 probes"):
        sst.candidate_files(files, probes, 2).collect()
