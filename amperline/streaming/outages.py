"""Block and clear events as a stream of outage windows, with keyed state and event-time timers.

A window runs from the first block of a streak to the next clear. Events within the watermark's
delay wait in the key's state, so their order in the files does not matter; a timer at each waiting
event settles it once the watermark has passed. Settled windows are final. What waits gives
provisional windows, and a streak that no clear has ended gives one of an hour (the open tail); a
key's later rows replace its earlier provisional ones, so the result at any time is what a batch
over all events so far would give. Events later than the delay are left out.

The RocksDB state store is set for the query only; the state is one row a key: the open block, a
version and the waiting events as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_US = 3_600_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pair(begun: int | None, events: list[tuple[int, int, bool]]) -> tuple[list[tuple[int, int]], int | None]:
    """(closed windows, begin of the one that is open) after sorted events (time, place, is a block)."""
    closed = []
    for at, _, block in events:
        if block:
            begun = at if begun is None else begun
        elif begun is not None:
            closed.append((begun, at))
            begun = None
    return closed, begun


def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's windows after more of its events, or after a timer; the key's state is read and written once."""
    begun, version, text = state.get if state.exists else (None, 0, "[]")
    events = [tuple(e) for e in json.loads(text)]
    for pdf in rows:
        events += zip(pdf["us"].tolist(), pdf["place"].tolist(), pdf["block"].tolist(), strict=True)
    events.sort()
    passed = state.getCurrentWatermarkMs() * 1000
    settled, left = [e for e in events if e[0] < passed], [e for e in events if e[0] >= passed]
    closed, begun = pair(begun, settled)
    later, tail = pair(begun, left)
    version += 1
    out = [(a, b, False, True) for a, b in closed] + [(a, b, False, False) for a, b in later]
    # the last row says that what this key gave before is replaced, also where nothing is open
    out.append((tail, None if tail is None else tail + HOUR_US, True, False))
    state.update((begun, version, json.dumps(left)))
    if left:
        state.setTimeoutTimestamp(left[0][0] // 1000 + 1)
    start, end, still, final = zip(*out, strict=True)
    yield pd.DataFrame({"key": [key[0]] * len(out), "version": [version] * len(out), "start_us": pd.array(start, "Int64"), "end_us": pd.array(end, "Int64"), "open": still, "final": final})


def outage_windows(events: DataFrame, key: str, ts: str, place: str, is_block: Column, is_clear: Column, delay: str, folder: str, checkpoint: str) -> DataFrame:
    """(key, start, end, open) of all events that have come so far; called again it goes on with what has come since."""
    spark = events.sparkSession
    kind = F.when(is_block, True).when(is_clear, False)
    marks = events.withWatermark(ts, delay).withColumn("block", kind).where(F.col("block").isNotNull())
    marks = marks.select(F.col(key).cast("long").alias("key"), ts, F.unix_micros(ts).alias("us"), F.col(place).cast("long").alias("place"), "block")
    windows = marks.groupBy("key").applyInPandasWithState(step, "key long, version long, start_us long, end_us long, open boolean, final boolean", "begun long, version long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", folder).format("parquet").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return current(spark.read.parquet(folder)).withColumnRenamed("key", key)


def current(rows: DataFrame) -> DataFrame:
    """Final windows and each key's last provisional ones."""
    newest = F.max("version").over(Window.partitionBy("key"))
    live = rows.withColumn("newest", newest).where("start_us IS NOT NULL AND (final OR version = newest)")
    return live.select("key", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), "open")
