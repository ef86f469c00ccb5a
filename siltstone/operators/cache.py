"""Cache state machines over access traces: anchored expiry, coalescing, byte-bounded LRU.

Folds read rows sorted by group and order within tasks and hold only the
machine's own state, so a long trace of one group never becomes one array.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.hashing import octets

# Capacity is split over 256 shards, at least 1024 bytes where that gives none; the hot tier has an eighth.
CACHE_SHARDS = 256
LEAST_SHARD_BYTES = 1024


def shard_capacity(capacity: int) -> int:
    return capacity // CACHE_SHARDS or LEAST_SHARD_BYTES


def hot_capacity(capacity: int) -> int:
    return capacity // 8


def _in_order(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    return rows.repartition(F.col(group)).sortWithinPartitions(group, *order)


def _schema(rows: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), more])


def sorted_fold(
    rows: DataFrame, group: str, order: list[str], start: Callable[[], object], step: Callable[..., object], args: list[str], result: str, out: str
) -> DataFrame:
    """``rows`` with a column of what ``step(state, *args)`` returns, along each group's order.

    Only the group and ``args`` become Python values; other columns pass through.
    """
    names, kind = rows.columns, to_arrow_type(_parse_datatype_string(result))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            found = []
            for value, *given in zip(batch.column(group).to_pylist(), *(batch.column(c).to_pylist() for c in args)):
                if value != now:
                    now, state = value, start()
                found.append(step(state, *given))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, out])

    return _in_order(rows, group, order).mapInArrow(run, _schema(rows, f"{out} {result}"))


def leaders(us: np.ndarray, first: np.ndarray, width: int, inclusive: bool, anchor: int | None) -> tuple[np.ndarray, int]:
    """Which rows open a window, and the last run's anchor; runs begin at ``first`` and ascend by ``us``.

    ``anchor`` is that of the first run, if it goes on from before.  All runs
    jump from window to window together.
    """
    n = len(us)
    ends = np.append(first[1:], n)
    sizes, side = ends - first, "right" if inclusive else "left"
    at = first.copy()
    if anchor is not None:
        at[0] = np.searchsorted(us[: ends[0]], anchor + width, side=side)
    width = min(width, int(us.max()) - int(us.min()) + 1)
    # Runs in a row on one axis, further apart than a window.
    low, span = us[first], us[ends - 1] - us[first] + width + 2
    line = us + np.repeat(np.concatenate([[0], np.cumsum(span)[:-1]]) - low, sizes)
    after = np.maximum(np.searchsorted(line, line + width, side=side), np.arange(1, n + 1))
    run_end = np.repeat(ends, sizes)
    out = np.zeros(n, bool)
    at = at[at < ends]
    while len(at):
        out[at] = True
        step = after[at]
        at = step[step < run_end[at]]
    opened = np.flatnonzero(out[first[-1] :])
    last = int(us[first[-1] + opened[-1]]) if len(opened) else anchor
    return out, last


def anchored_leaders(access: DataFrame, width: int, inclusive: bool) -> DataFrame:
    """``access`` (key, us, tie) with leads: whether a row opens a window anchored at itself.

    A window holds rows up to ``width`` after its anchor, the end included if
    ``inclusive`` (expiry: an entry is live at its last instant) or not (a call
    in flight).  Windows follow loads, not uses, so gaps don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = pc.run_end_encode(batch.column("key")).run_ends.to_numpy()
            first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            same = anchor is not None and batch.column("key")[0].as_py() == key
            leads, anchor = leaders(batch.column("us").to_numpy(), first, width, inclusive, anchor if same else None)
            key = batch.column("key")[batch.num_rows - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leads)], ["key", "us", "tie", "leads"])

    rows = access.select("key", "us", "tie")
    return _in_order(rows, "key", ["us", "tie"]).mapInArrow(run, _schema(rows, "leads boolean"))


def hits_and_misses(access: DataFrame, ttl_us: int) -> DataFrame:
    """Hits and misses of each key where entries live ``ttl_us`` from their load."""
    led = anchored_leaders(access, ttl_us, True)
    return led.groupBy("key").agg(F.count_if(~F.col("leads")).alias("hits"), F.count_if("leads").alias("misses"))


def coalesced_calls(calls: DataFrame, duration_us: int) -> DataFrame:
    """Calls of each key that load, and calls that share a load in flight."""
    led = anchored_leaders(calls, duration_us, False)
    return led.groupBy("key").agg(F.count_if("leads").alias("leaders"), F.count_if(~F.col("leads")).alias("coalesced"))


def lru_hits_by(access: DataFrame, order: list[str], capacity: int) -> DataFrame:
    """``access`` (shard, order..., key, nbytes) with hit: read-through LRU, bounded by bytes in each shard.

    A miss adds the key and then drops the least recent ones while the shard is
    too large; one that is too large by itself empties the shard.  Capacity 0 is
    unbounded.
    """

    def step(held: OrderedDict, key: str, nbytes: int) -> bool:
        if key in held:
            held.move_to_end(key)
            return True
        used = held.pop(_USED, 0) + nbytes
        held[key] = nbytes
        while capacity and used > capacity:
            used -= held.popitem(last=False)[1]
        held[_USED] = used
        held.move_to_end(_USED, last=False)
        return False

    return sorted_fold(access.select("shard", *order, "key", "nbytes"), "shard", order, OrderedDict, step, ["key", "nbytes"], "boolean", "hit")


_USED = ("bytes in use",)  # no key of a trace is a tuple


MACHINE = "struct<hit:boolean,value:string,evicted:array<string>,items:int,bytes:bigint>"


def lru_machine(ops: DataFrame, capacity: int) -> DataFrame:
    """``ops`` (shard, seq, op, key, value, ttl, at) with what each did: hit, value, evicted keys in order, items, bytes.

    ``op`` is get, add, remove or purge.  get finds an entry unless it expired
    before ``at``, and makes it the most recent; add replaces or inserts, with an
    expiry if ttl is positive, and then drops the least recent while the shard
    is over ``capacity`` (0: unbounded); remove drops one key; purge drops all
    that expired.  Every drop counts as an eviction.
    """

    def step(held: OrderedDict, op: str, key: str, value: str | None, ttl: int | None, at: int | None) -> dict:
        size = lambda k: len(k.encode()) + len(held[k][0].encode())
        state = held.setdefault(_USED, [0])
        held.move_to_end(_USED, last=False)
        hit, found, gone = False, None, []

        def drop(k: str) -> None:
            state[0] -= size(k)
            del held[k]
            gone.append(k)

        if op == "get":
            if key in held and held[key][1] is not None and held[key][1] < at:
                drop(key)
            elif key in held:
                hit, found = True, held[key][0]
                held.move_to_end(key)
        elif op == "add":
            if key in held:
                state[0] -= size(key)
            held[key] = (value or "", at + ttl if ttl and ttl > 0 else None)
            held.move_to_end(key)
            state[0] += size(key)
            while capacity and state[0] > capacity:
                drop(next(k for k in held if k != _USED))
        elif op == "remove" and key in held:
            drop(key)
        elif op == "purge":
            for k in [k for k in held if k != _USED and held[k][1] is not None and held[k][1] < at]:
                drop(k)
        return {"hit": hit, "value": found, "evicted": gone, "items": len(held) - 1, "bytes": state[0]}

    rows = ops.select("shard", "seq", "op", "key", "value", "ttl", "at")
    return sorted_fold(rows, "shard", ["seq"], OrderedDict, step, ["op", "key", "value", "ttl", "at"], MACHINE, "done")


def _from_end(adds: DataFrame) -> DataFrame:
    later = Window.partitionBy("shard").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return adds.withColumn("from_end", F.sum("nbytes").over(later))


def lru_contents(adds: DataFrame, capacity: int) -> DataFrame:
    """What write-only adds of distinct keys leave: in each shard, the longest suffix that fits.

    ``adds`` has shard, seq, key, nbytes.  An entry stays if it and all later
    ones fit together.
    """
    return _from_end(adds).where(F.col("from_end") <= capacity).drop("from_end")


def lru_overflow(adds: DataFrame, capacity: int) -> DataFrame:
    """The rows that ``lru_contents`` leaves out; capacity 0 is unbounded."""
    return _from_end(adds).where((F.col("from_end") > capacity) & F.lit(capacity > 0)).drop("from_end")


def bytes_used(entries: DataFrame) -> DataFrame:
    """Bytes and items of each shard, from current (shard, key, value)."""
    size = octets(F.col("key")) + octets(F.col("value"))
    return entries.groupBy("shard").agg(F.sum(size).alias("bytes"), F.count("*").alias("items"))


def recency(access: DataFrame, shard: Column) -> DataFrame:
    """Keys of each shard from most to least recent: (shard, key, position).

    ``access`` has key and seq; ``shard`` is computed once a key, after merging.
    """
    last = access.groupBy("key").agg(F.max("seq").alias("last")).withColumn("shard", shard)
    order = Window.partitionBy("shard").orderBy(F.col("last").desc())
    return last.select("shard", "key", F.row_number().over(order).cast("bigint").alias("position"))


def live_lru(expire_at: Column, now: Column) -> Column:
    """Cache entries live through their last instant; none means for ever."""
    return expire_at.isNull() | (expire_at >= now)


def expiry(loaded_at: Column, ttl: int, client: bool = False) -> Column:
    """When an entry expires: a cache takes a ttl of 0 or less as never, a client as at once."""
    return F.lit(None).cast("bigint") if ttl <= 0 and not client else loaded_at + ttl
