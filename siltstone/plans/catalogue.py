"""The registered queries over the test tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..group import Group, GroupOptions
from ..operators import cache, kvlog, ring, routes, sst, tiers
from ..session import ship_package, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Parameters of the queries.
POINT_KEY, SEEK_KEY, SEEK_ROWS, TORN_AT = "user-7", "user-3", 25, 2000
PROBES = ["user-0", "user-1", "user-75", "user-99", "user-zzz"]
TTL_US, CALL_US = 6 * 3600 * 10**6, 3600 * 10**6
LOAD_US = 100 * 24 * 3600 * 10**6
LRU_BYTES, PART_BYTES = 16384, 8192
NOW = 25
SELF_NODE = "CHINA"
CUT = "2024-01-20 00:00:00"


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = sql
        return run

    return register


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvlog.event_log(table(spark, sf_dir, "events"))


# --- DuckDB fragments ------------------------------------------------------------------------------------------------

LOG = """l AS (SELECT 'user-' || user_id AS key, ts, event_id,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
  event_type || ':' || event_id AS value, (ts::DATE - DATE '1970-01-01')::INT AS file_no FROM events)"""
LAST = f"{LOG}, m AS (SELECT key, arg_max(op, (ts, event_id)) AS op, arg_max(value, (ts, event_id)) AS value FROM l GROUP BY key)"
RAW = f"""{LOG}, q AS (SELECT *, row_number() OVER (PARTITION BY file_no, key ORDER BY ts DESC, event_id DESC) AS rn FROM l),
r AS (SELECT file_no, key, CASE WHEN op = 'put' THEN value END AS value, op = 'delete' AS is_deleted FROM q WHERE rn = 1)"""


def _octets(c: str) -> str:
    return f"octet_length(encode({c}))::BIGINT"


def _bytes_sql(c: str) -> str:
    return f"list_transform(range(1, {_octets(c)} + 1), lambda i: ('0x' || substr(hex(encode({c})), (2 * i - 1)::BIGINT, 2))::BIGINT)"


def _fnv_sql(c: str) -> str:
    return f"list_reduce(list_prepend({hashing.FNV_OFFSET}::BIGINT, {_bytes_sql(c)}), lambda h, b: (xor(h, b) * {hashing.FNV_PRIME}) % 4294967296)"


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return out


def _crc_sql(c: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_bytes_sql(c)}), "
        f"lambda c, b: xor(c >> 8, (({_crc_table()})::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"
    )


def _points_sql(name: str, nodes: str) -> str:
    return f"""{name}_l AS (SELECT i || node AS label, node, added, i FROM ({nodes}), range({ring.REPLICAS}) AS r(i)),
{name}_h AS (SELECT {_crc_sql("label")} AS h, node, added, i FROM {name}_l),
{name} AS (SELECT h, arg_max(node, (added, i)) AS node FROM {name}_h GROUP BY h)"""


def _owners_sql(name: str, keys: str, points: str) -> str:
    """Brute-force successor: the least point at or after the hash, else the least of all."""
    return f"""{name} AS (SELECT key, coalesce(
  (SELECT min_by(p.node, p.h) FROM {points} p WHERE p.h >= k.h), (SELECT min_by(p.node, p.h) FROM {points} p)) AS owner
  FROM (SELECT key, {_crc_sql("key")} AS h FROM ({keys})) k)"""


NODES = "SELECT n_name AS node, n_nationkey AS added FROM nation WHERE n_regionkey < 3"
GROWN = "SELECT n_name AS node, n_nationkey AS added FROM nation WHERE n_regionkey < 4"
KEYS = "SELECT c_name AS key FROM customer"


def _nodes(spark: SparkSession, sf_dir: str, regions: int = 3) -> DataFrame:
    return table(spark, sf_dir, "nation").where(F.col("n_regionkey") < regions).select(F.col("n_name").alias("node"), F.col("n_nationkey").alias("added"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))


# --- storage ---------------------------------------------------------------------------------------------------------


@query(f"WITH {LAST} SELECT key, value FROM m WHERE op = 'put' AND key = '{POINT_KEY}'")
def q01_kv_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvlog.point_get(kvlog.event_log(kvlog.user_events(table(spark, sf_dir, "events"), POINT_KEY)), POINT_KEY)


@query(f"WITH {LAST} SELECT key, value FROM m WHERE op = 'put'")
def q02_kv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvlog.snapshot(_log(spark, sf_dir))


@query(f"WITH {RAW} SELECT * FROM r")
def q03_kv_raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvlog.raw_scan(_log(spark, sf_dir))


@query(f"WITH {LAST} SELECT key, value FROM m WHERE op = 'put' AND key >= '{SEEK_KEY}' ORDER BY key LIMIT {SEEK_ROWS}")
def q04_kv_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvlog.seek(_log(spark, sf_dir), SEEK_KEY, SEEK_ROWS)


WAL = f"""{LOG}, b AS (SELECT *, 9 + {_octets("key")} + CASE WHEN op = 'put' THEN {_octets("value")} ELSE 0 END AS n FROM l),
o AS (SELECT file_no, event_id, key, op, (sum(n) OVER (PARTITION BY file_no ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS end_offset, n FROM b)"""


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sst.wal_offsets(_log(spark, sf_dir))
    return rows.select("file_no", F.col("seq.event_id").alias("event_id"), "key", "op", "start_offset", "end_offset")


@query(f"WITH {WAL} SELECT file_no, event_id, key, op, end_offset - n AS start_offset, end_offset FROM o")
def q05_wal_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir)


@query(f"WITH {WAL} SELECT file_no, event_id, key, op, end_offset - n AS start_offset, end_offset FROM o WHERE end_offset <= {TORN_AT}")
def q06_wal_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.truncate_torn(_offsets(spark, sf_dir), TORN_AT)


MANIFEST = f"""{RAW}, f AS (SELECT file_no, min(key) AS smallest, max(key) AS largest, count(*) AS num_entries,
  sum(9 + {_octets("key")} + coalesce({_octets("value")}, 0))::BIGINT AS data_bytes FROM r GROUP BY file_no)"""


@query(f"WITH {MANIFEST} SELECT *, (SELECT max(file_no) + 1 FROM r)::INT AS next_file_no, 0 AS level FROM f")
def q07_sst_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.manifest(kvlog.raw_scan(_log(spark, sf_dir)))


PROBE_SQL = "SELECT unnest([" + ", ".join(f"'{p}'" for p in PROBES) + "]) AS key"


def _probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PROBES], "key string")


@query(f"WITH {MANIFEST}, p AS ({PROBE_SQL}) SELECT p.key, f.file_no FROM p JOIN f ON p.key BETWEEN f.smallest AND f.largest")
def q08_zone_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.candidate_files(sst.manifest(kvlog.raw_scan(_log(spark, sf_dir))), _probes(spark))


@query(f"""WITH {RAW}, p AS ({PROBE_SQL}), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file_no DESC) AS k FROM r)
SELECT p.key, CASE WHEN n.key IS NULL THEN 0 WHEN is_deleted THEN 2 ELSE 1 END AS code, file_no, value
FROM p LEFT JOIN n ON n.key = p.key AND n.k = 1""")
def q09_merge_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvlog.merge_get(_log(spark, sf_dir), _probes(spark))


@query(f"""WITH {RAW} SELECT file_no, key, (sum(9 + {_octets("key")} + coalesce({_octets("value")}, 0))
  OVER (PARTITION BY file_no ORDER BY key ROWS UNBOUNDED PRECEDING) - (9 + {_octets("key")} + coalesce({_octets("value")}, 0)))::BIGINT AS entry_offset, is_deleted FROM r""")
def q10_sst_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.entry_offsets(kvlog.raw_scan(_log(spark, sf_dir)))


@query(f"WITH {LAST} SELECT key, value FROM m WHERE op = 'put'")
def q11_tombstone_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvlog.live_reads(_log(spark, sf_dir), strict=True)


@query(f"""WITH {RAW}, t AS (SELECT max(file_no) AS top FROM l),
a AS (SELECT key, value FROM r, t WHERE file_no = top AND NOT is_deleted),
z AS (SELECT key, arg_max(is_deleted, file_no) AS dead, arg_max(coalesce(value, ''), file_no) AS value FROM r, t WHERE file_no < top GROUP BY key)
SELECT key, value FROM a UNION ALL SELECT key, value FROM z WHERE NOT dead AND key NOT IN (SELECT key FROM a)""")
def q11_tombstone_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvlog.live_reads(_log(spark, sf_dir), strict=False)


# --- hashing and rings -----------------------------------------------------------------------------------------------


@query(f"SELECT ({_fnv_sql('c_name')} % 256)::INT AS shard, count(*) AS keys FROM customer GROUP BY 1")
def q12_shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).groupBy(hashing.shard_of(F.col("key")).alias("shard")).agg(F.count("*").alias("keys"))


@query(f"WITH {_points_sql('pts', NODES)} SELECT h, node FROM pts")
def q13_ring_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.ring_points(_nodes(spark, sf_dir))


OWNED = f"{_points_sql('pts', NODES)}, {_owners_sql('own', KEYS, 'pts')}"


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.owners(_customers(spark, sf_dir), ring.ring_points(_nodes(spark, sf_dir)))


@query(f"WITH {OWNED} SELECT key, owner FROM own")
def q14_ring_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned(spark, sf_dir)


@query(f"WITH {OWNED} SELECT owner, count(*) AS keys FROM own GROUP BY owner")
def q15_ring_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned(spark, sf_dir).groupBy("owner").agg(F.count("*").alias("keys"))


@query(f"""WITH {OWNED}, {_points_sql('more', GROWN)}, {_owners_sql('own2', KEYS, 'more')}
SELECT key, own.owner AS old_owner, own2.owner AS new_owner FROM own JOIN own2 USING (key) WHERE own.owner <> own2.owner""")
def q16_ring_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (ring.ring_points(_nodes(spark, sf_dir, n)) for n in (3, 4))
    return ring.moved(_customers(spark, sf_dir), before, after)


@query(f"WITH {OWNED} SELECT key, owner, owner <> '{SELF_NODE}' AS is_remote FROM own")
def q17_ring_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned(spark, sf_dir).withColumn("is_remote", F.col("owner") != SELF_NODE)


@query(f"WITH {_points_sql('pts', NODES)} SELECT DISTINCT node FROM pts")
def q18_ring_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.ring_points(_nodes(spark, sf_dir)).select("node").distinct()


# --- cache state machines --------------------------------------------------------------------------------------------


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.concat(F.lit("user-"), F.col("user_id")).alias("key"), us.alias("us"), F.col("event_id").alias("tie"))


def _anchored_sql(width: int, compare: str, led: str, rest: str) -> str:
    """Anchors by recursion from each key's first row to the first row past its window."""
    return f"""WITH RECURSIVE t AS (SELECT 'user-' || user_id AS key, epoch_us(ts) AS us FROM events),
a AS (SELECT key, min(us) AS us FROM t GROUP BY key UNION ALL
  SELECT key, nxt FROM (SELECT a.key, (SELECT min(t.us) FROM t WHERE t.key = a.key AND t.us {compare} a.us + {width}) AS nxt FROM a) WHERE nxt IS NOT NULL),
n AS (SELECT key, count(*) AS anchors FROM a GROUP BY key), c AS (SELECT key, count(*) AS rows FROM t GROUP BY key)
SELECT key, (rows - anchors)::BIGINT AS {rest}, anchors::BIGINT AS {led} FROM c JOIN n USING (key)"""


@query(_anchored_sql(TTL_US, ">", "misses", "hits"))
def q19_ttl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hits_and_misses(_trace(spark, sf_dir), TTL_US)


@query(_anchored_sql(CALL_US, ">=", "leaders", "coalesced"))
def q20_singleflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.coalesced_calls(_trace(spark, sf_dir), CALL_US)


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("part-"), F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select(
        hashing.shard_of(key).alias("shard"), F.struct(*LINE_ORDER).alias("seq"), key.alias("key"), (hashing.octets(key) + 8).alias("nbytes")
    )


ACCESSES = f"""k AS (SELECT DISTINCT 'part-' || l_partkey AS key, l_partkey AS p FROM lineitem),
s AS (SELECT *, ({_fnv_sql('key')} % 256)::INT AS shard, {_octets('key')} + 8 AS nbytes FROM k),
t AS (SELECT shard, key, nbytes, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS seq, {', '.join(LINE_ORDER)} FROM lineitem JOIN s ON p = l_partkey)"""


@query(f"""WITH {ACCESSES},
w AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS nxt FROM t),
d AS (SELECT a.seq, a.nbytes + coalesce(sum(b.nbytes), 0) AS need FROM w a LEFT JOIN w b
  ON b.shard = a.shard AND b.seq > a.prev AND b.seq < a.seq AND (b.nxt IS NULL OR b.nxt > a.seq) WHERE a.prev IS NOT NULL GROUP BY a.seq, a.nbytes)
SELECT shard, count(*) AS accesses, count(*) FILTER (d.need <= {LRU_BYTES // 256}) AS hits FROM w LEFT JOIN d USING (seq) GROUP BY shard""")
def q21_lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = _accesses(spark, sf_dir)
    flat = trace.select("shard", *[F.col(f"seq.{c}").alias(c) for c in LINE_ORDER], "key", "nbytes")
    return cache.lru_hits_by(flat, LINE_ORDER, cache.shard_capacity(LRU_BYTES)).groupBy("shard").agg(
        F.count("*").alias("accesses"), F.count_if("hit").alias("hits")
    )


def _part_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("part-"), F.col("p_partkey"))
    size = hashing.octets(key) + hashing.octets(F.col("p_name"))
    return table(spark, sf_dir, "part").select(hashing.shard_of(key).alias("shard"), F.col("p_partkey").alias("seq"), key.alias("key"), size.alias("nbytes"), F.col("p_name").alias("value"))


PART = f"""k AS (SELECT 'part-' || p_partkey AS key, p_partkey AS seq, p_name AS value FROM part),
s AS (SELECT *, ({_fnv_sql('key')} % 256)::INT AS shard, {_octets('key')} + {_octets('value')} AS nbytes FROM k)"""


@query(f"""WITH {PART}, z AS (SELECT *, sum(nbytes) OVER (PARTITION BY shard ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT shard, key, value FROM z WHERE n <= {PART_BYTES // 256}""")
def q22_lru_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.lru_contents(_part_adds(spark, sf_dir), cache.shard_capacity(PART_BYTES)).select("shard", "key", "value")


@query(f"WITH {PART} SELECT shard, sum(nbytes)::BIGINT AS bytes, count(*) AS items FROM s GROUP BY shard")
def q23_lru_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.bytes_used(_part_adds(spark, sf_dir))


@query(f"""SELECT 'part-' || p_partkey AS key, p_size AS expire_at, p_size >= {NOW} AS live_lru, NOT ({NOW} > p_size) AS live_client,
true AS live_lru_ttl0, {NOW} <= p_size AS live_client_ttl0 FROM part""")
def q24_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, at = F.lit(NOW).cast("bigint"), F.col("p_size").cast("bigint")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey")).alias("key"),
        F.col("p_size").alias("expire_at"),
        cache.live_lru(at, now).alias("live_lru"),
        (~(now > at)).alias("live_client"),
        cache.live_lru(cache.expiry(at, 0), now).alias("live_lru_ttl0"),
        (~(now > cache.expiry(at, 0, client=True))).alias("live_client_ttl0"),
    )


# --- tiers, writes, invalidation, routing ----------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT DISTINCT 'part-' || l_partkey AS key, l_partkey AS p FROM lineitem UNION SELECT 'gone-' || s_suppkey, s_suppkey FROM supplier),
s AS (SELECT 'part-' || p_partkey AS key, p_partkey AS p, p_size, CASE WHEN p_size > 1 THEN p_name END AS v FROM part),
x AS (SELECT r.key, r.p % 3 = 0 AS remote, s.key IS NOT NULL AS known, coalesce(v, '') AS v, s.p % 11 = 0 AND p_size >= {NOW} AS hot,
  s.p % 7 = 0 AND p_size >= {NOW} AS main, s.p % 5 = 0 AS l3 FROM r LEFT JOIN s ON s.key = r.key)
SELECT key, CASE WHEN hot THEN 'hot:' || v WHEN main THEN 'main:' || v WHEN remote AND known THEN v WHEN NOT remote AND l3 THEN 'l3:' || v WHEN NOT remote AND known THEN v END AS value,
CASE WHEN hot THEN 'hot' WHEN main THEN 'main' WHEN remote AND known THEN 'peer' WHEN NOT remote AND l3 THEN 'l3' WHEN NOT remote AND known THEN 'source' ELSE 'miss' END AS tier FROM x""")
def q25_tier_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey")).alias("key"), "p_partkey", F.col("p_size").cast("bigint").alias("expire_at"),
        F.when(F.col("p_size") > 1, F.col("p_name")).alias("value"),
    )
    named = lambda tier, n: parts.where(F.col("p_partkey") % n == 0).select("key", F.concat(F.lit(f"{tier}:"), F.coalesce("value", F.lit(""))).alias("value"), "expire_at")
    asked = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part-"), F.col("l_partkey")).alias("key"), F.col("l_partkey").alias("p")).distinct()
    absent = table(spark, sf_dir, "supplier").select(F.concat(F.lit("gone-"), F.col("s_suppkey")).alias("key"), F.col("s_suppkey").alias("p"))
    requests = asked.unionByName(absent).select("key", (F.col("p") % 3 == 0).alias("is_remote"))
    return tiers.tiered_read(requests, NOW, named("hot", 11), named("main", 7), named("l3", 5), parts)


@query(f"""WITH w AS (SELECT 'user-' || user_id AS key, event_type || ':' || event_id AS value, event_id, ts,
  CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 36 HOUR END AS d FROM events WHERE event_type <> 'error'),
c AS (SELECT key, arg_max(value, (ts, event_id)) AS cached FROM w WHERE ts <= TIMESTAMP '{CUT}' GROUP BY key),
d AS (SELECT key, arg_max(value, (d, event_id)) AS durable FROM w WHERE d <= TIMESTAMP '{CUT}' GROUP BY key)
SELECT key, cached, durable FROM c LEFT JOIN d USING (key)""")
def q26_write_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type <> 'error'")
    writes = events.select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("key"),
        F.concat_ws(":", "event_type", "event_id").alias("value"),
        F.when(F.col("event_id") % 2 == 0, tiers.WRITE_THROUGH).otherwise(tiers.WRITE_BACK).alias("strategy"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("event_id").alias("tie"),
    )
    cut = spark.sql(f"SELECT unix_micros(timestamp '{CUT}') AS c").first()["c"]
    return tiers.write_states(writes, cut, 36 * 3600 * 10**6).select("key", "cached", "durable")


@query(f"""WITH {LOG}, p AS (SELECT key, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM l WHERE op = 'put' GROUP BY key)
SELECT key, value FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE op = 'delete' AND l.key = p.key AND l.ts >= p.at)""")
def q27_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    loads = log.where("op = 'put'").groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq.ts").alias("at"))
    return tiers.surviving(loads, log.where("op = 'delete'").select("key", F.col("seq.ts").alias("at"))).select("key", "value")


@query(f"""WITH n AS ({NODES}), k AS (SELECT DISTINCT 'user-' || user_id AS key FROM events WHERE event_type = 'error')
SELECT key, node, 'grpc' AS transport FROM k, n UNION ALL SELECT key, node, 'http' FROM k, n WHERE node <> '{SELF_NODE}'""")
def q28_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _log(spark, sf_dir).where("op = 'delete'").select("key").distinct()
    sent = [tiers.fan_out(keys, _nodes(spark, sf_dir), SELF_NODE, t).withColumn("transport", F.lit(t)) for t in ("grpc", "http")]
    return sent[0].unionByName(sent[1])


PATH = r"regexp_replace(url, '^[a-z]+://[^/]*', '')"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))


PARSED = f"""p AS (SELECT page_id, {PATH} AS path FROM pages), g AS (SELECT *, substr(path, 2) AS rest FROM p),
h AS (SELECT page_id, path, CASE WHEN path LIKE '/%' AND contains(rest, '/') THEN split_part(rest, '/', 1) END AS "group",
  CASE WHEN path LIKE '/%' AND contains(rest, '/') THEN substr(rest, instr(rest, '/') + 1) END AS key FROM g)"""


@query(f'WITH {PARSED} SELECT page_id, "group", key FROM h')
def q29_route_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    group, key = routes.parse_path(F.col("path"), "/")
    return _paths(spark, sf_dir).select("page_id", group.alias("group"), key.alias("key"))


REQUESTS = """p AS (SELECT n_nationkey AS i, n_name AS name FROM nation),
q AS (SELECT i, CASE WHEN i % 4 = 0 THEN 'DELETE' ELSE 'GET' END AS method, CASE i % 5 WHEN 0 THEN '/other/x' WHEN 1 THEN '/_cache/nations'
  WHEN 2 THEN '/_cache/nobody/' || name WHEN 3 THEN '/_cache/nations/' || name ELSE '/_cache/nations/' || CASE WHEN i % 2 = 0 THEN '' ELSE 'nowhere/' || name END END AS path FROM p)"""


@query(f"""WITH {REQUESTS}, z AS (SELECT *, CASE WHEN path LIKE '/_cache/%' THEN substr(path, 9) END AS rest FROM q),
y AS (SELECT *, CASE WHEN contains(rest, '/') THEN split_part(rest, '/', 1) END AS g, CASE WHEN contains(rest, '/') THEN substr(rest, instr(rest, '/') + 1) END AS k FROM z)
SELECT i, method, path, g AS "group", k AS key, CASE WHEN g IS NULL THEN 400 WHEN g <> 'nations' THEN 404 WHEN method = 'DELETE' THEN 200
WHEN k <> '' AND k IN (SELECT n_name FROM nation) THEN 200 ELSE 500 END AS status, CASE WHEN method = 'DELETE' THEN 'remove' ELSE 'read' END AS action FROM y""")
def q30_route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, name = F.col("n_nationkey"), F.col("n_name")
    path = (
        F.when(i % 5 == 0, F.lit("/other/x")).when(i % 5 == 1, F.lit("/_cache/nations")).when(i % 5 == 2, F.concat(F.lit("/_cache/nobody/"), name))
        .when(i % 5 == 3, F.concat(F.lit("/_cache/nations/"), name))
        .otherwise(F.concat(F.lit("/_cache/nations/"), F.when(i % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("nowhere/"), name))))
    )
    nation = table(spark, sf_dir, "nation")
    requests = nation.select(i.alias("i"), F.when(i % 4 == 0, "DELETE").otherwise("GET").alias("method"), path.alias("path"))
    source = nation.select(F.lit("nations").alias("group"), name.alias("key"))
    return routes.route(requests, spark.createDataFrame([("nations",)], "group string"), source, "/_cache/")


@query(f"SELECT doc_id, {_octets('text')} AS n_bytes, length(text)::BIGINT AS n_points FROM documents")
def q31_byte_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashing.octets(F.col("text")).alias("n_bytes"), F.length("text").cast("bigint").alias("n_points"))


@query(f"""WITH {ACCESSES}, u AS (SELECT shard, key, max(seq) AS last FROM t GROUP BY shard, key)
SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY last DESC) AS "position" FROM u""")
def q32_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.recency(_accesses(spark, sf_dir).select("key", "seq"), hashing.shard_of(F.col("key")))


@query(f"""WITH RECURSIVE t AS (SELECT 'part-' || l_partkey AS key, epoch_us(l_shipdate) AS us, count(*) AS n FROM lineitem GROUP BY ALL),
a AS (SELECT key, min(us) AS us FROM t GROUP BY key UNION ALL
  SELECT key, nxt FROM (SELECT a.key, (SELECT min(t.us) FROM t WHERE t.key = a.key AND t.us > a.us + {LOAD_US}) AS nxt FROM a) WHERE nxt IS NOT NULL),
l AS (SELECT key, count(*) AS loads, max(us) AS last FROM a GROUP BY key), r AS (SELECT key, sum(n)::BIGINT AS reads FROM t GROUP BY key)
SELECT key, reads, loads::BIGINT AS loads, (last + {LOAD_US})::BIGINT AS expires_us FROM r JOIN l USING (key)""")
def q33_load_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of parts in the order they were shipped, each load serving those of a hundred days."""
    lines = table(spark, sf_dir, "lineitem")
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    reads = lines.select(F.concat(F.lit("part-"), F.col("l_partkey")).alias("key"), us.alias("us"), F.struct("l_orderkey", "l_linenumber").alias("tie"))
    led = cache.anchored_leaders(reads, LOAD_US, True)
    loaded = F.max(F.when(F.col("leads"), F.col("us")))
    return led.groupBy("key").agg(F.count("*").alias("reads"), F.count_if("leads").alias("loads"), (loaded + LOAD_US).alias("expires_us"))


# --- groups ----------------------------------------------------------------------------------------------------------

GROUP_BYTES, GROUP_TTL, PURGE_AT = 1 << 16, 1000, 1500


def _part_group(spark: SparkSession, sf_dir: str, options: GroupOptions) -> Group:
    """A group of its own, unregistered, that reads part names."""
    source = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey")).alias("key"), F.col("p_name").alias("value"))
    return Group(spark, "parts", lambda keys: source.join(keys, "key"), options, setter=lambda rows: None)


def _part_keys(spark: SparkSession, sf_dir: str, n: int, rest: int) -> DataFrame:
    parts = table(spark, sf_dir, "part").where(F.col("p_partkey") % n == rest)
    return parts.select(F.concat(F.lit("part-"), F.col("p_partkey")).alias("key"))


@query(f"""WITH {PART}, u AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 1 ELSE 2 END AS call FROM s WHERE seq % 3 < 2),
z AS (SELECT *, sum(nbytes) OVER (PARTITION BY shard ORDER BY call DESC, key DESC ROWS UNBOUNDED PRECEDING) AS n FROM u)
SELECT key, value FROM z WHERE n <= {GROUP_BYTES // 256}""")
def q34_group_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two reads of many keys leave in a group whose main tier can't hold them."""
    group = _part_group(spark, sf_dir, GroupOptions(cache_bytes=GROUP_BYTES))
    for rest in (0, 1):
        group.get(_part_keys(spark, sf_dir, 3, rest), 0)
    return group.main.select("key", "value")


@query(f"""SELECT 'part-' || p_partkey AS key, p_name AS value, CASE WHEN p_partkey % 2 = 0 THEN {GROUP_TTL} ELSE {GROUP_TTL + 1000} END::BIGINT AS expire_at
FROM part WHERE p_partkey % 2 = 1 OR {GROUP_TTL} >= {PURGE_AT}""")
def q35_group_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cleanup leaves of entries that two writes, a second apart, have cached."""
    group = _part_group(spark, sf_dir, GroupOptions(main_ttl=GROUP_TTL))
    for rest in (0, 1):
        parts = table(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == rest)
        group.set(parts.select(F.concat(F.lit("part-"), F.col("p_partkey")).alias("key"), F.col("p_name").alias("value")), rest * 1000)
    group.purge(PURGE_AT)
    return group.main


@query(f"""WITH {LOG}, p AS (SELECT key, arg_max(value, (ts, event_id)) AS value FROM l GROUP BY key)
SELECT key, value, 'main' AS tier FROM p""")
def q36_group_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One write of a whole log, in which keys repeat, then a read of every key: the last row of a key holds."""
    group = _part_group(spark, sf_dir, GroupOptions())
    log = _log(spark, sf_dir)
    group.set(log.orderBy("seq").select("key", "value"), 0)
    return group.get(log.select("key"), 0)
