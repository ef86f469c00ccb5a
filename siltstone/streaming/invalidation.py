"""Cache state under streams of loads and invalidations.

A stream has key, kind ('load' or 'invalidate'), value and at.  An invalidation
removes an entry loaded at or before it, whatever order the rows arrive in:
deletes commute, so late and repeated messages do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_rocksdb(spark: SparkSession) -> None:
    """State on disk rather than on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _fold(ttl_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [None], "live": [False]})
            return
        loaded, value, gone = state.get if state.exists else (None, None, None)
        latest = 0
        for frame in frames:
            out = frame["kind"] == "invalidate"
            if out.any():
                most = int(frame.loc[out, "at"].max())
                gone = most if gone is None else max(gone, most)
            loads = frame[~out]
            if len(loads):
                at = int(loads["at"].max())
                text = max(loads.loc[loads["at"] == at, "value"].fillna(""))
                if loaded is None or (at, text) > (loaded, value or ""):
                    loaded, value = at, text
            if ttl_ms is not None:
                latest = max(latest, int(frame["ts"].max().timestamp() * 1000))
        state.update((loaded, value, gone))
        if ttl_ms is not None:
            state.setTimeoutTimestamp(max(latest + ttl_ms, state.getCurrentWatermarkMs() + 1))
        live = loaded is not None and (gone is None or gone < loaded)
        yield pd.DataFrame({"key": [key[0]], "value": [value if live else None], "live": [live]})

    return run


def cache_state(messages: DataFrame, ttl_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """After each batch, (key, value, live) of the keys that it touched; state is one row a key.

    With ``ttl_ms`` messages have an event time ts too: a key that no message
    touched for so long, by the watermark (``delay`` behind the latest ts), is
    reported as not live and its state, tombstones included, is forgotten.  No
    message may then be later than that.
    """
    if ttl_ms is not None:
        messages = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return messages.groupBy("key").applyInPandasWithState(
        _fold(ttl_ms),
        "key string, value string, live boolean",
        "loaded bigint, value string, gone bigint",
        "update",
        GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.EventTimeTimeout,
    )


def expired_windows(loads: DataFrame, ttl: str, delay: str) -> DataFrame:
    """Loads by ttl-long window of event time, emitted once the watermark has passed the window.

    ``loads`` has key and ts; a timestamp without zone is read as UTC.
    """
    timed = loads.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).groupBy(F.window("ts", ttl), "key").agg(F.count("*").alias("loads"))


def write_behind(writes: DataFrame, setter: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands every batch to ``setter(batch, id)``, as a source of truth would take it."""
    return writes.writeStream.foreachBatch(setter).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cleanup(ticks: DataFrame, purge: Callable[[int], None], checkpoint: str):
    """Start a stream that calls ``purge(now)`` with the latest time of each batch of ticks (at): a periodic cleanup."""

    def tick(batch: DataFrame, _: int) -> None:
        now = batch.agg(F.max("at").alias("now")).first()["now"]
        if now is not None:
            purge(int(now))

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).start()
