"""Stateful streams: first sight of a key, sliding-window rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def first_seen(stream: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """Rows whose key has not come before, while it is within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def allow(hits: list[int], at: int, window: int, limit: int) -> tuple[list[int], bool, int]:
    """One step of the limiter: the hits still held, whether this one passes, and the wait if not. Denied hits are not held."""
    held = [t for t in hits if t > at - window]
    if len(held) < limit:
        return [*held, at], True, 0
    return held, False, max(1, held[0] + window - at)


#: Rows of a batch that a stream gives back.
CHUNK = 10_000
OUT = "key long, id long, at long, allowed boolean, wait long"


def limit_batch(df: DataFrame, window: int, limit: int) -> DataFrame:
    """df (key, id, at in seconds) with allowed and wait, as in order of (at, id); without a time both are null.

    A gap of a window or more empties the limiter, so a key's sessions between such gaps are limited apart. They are found
    over windows of time, of which none holds a gap; a session is folded in order, with no more than `limit` hits in memory.
    """
    slot = F.floor(F.col("at") / window).cast("long")
    rows = df.select(F.col("key").cast("long"), F.col("id").cast("long"), F.col("at").cast("long")).withColumn("slot", slot)
    slots = rows.groupBy("key", "slot").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    order = Window.partitionBy("key").orderBy("slot")
    begins = F.coalesce(F.col("least") - F.lag("most").over(order) >= window, F.lit(True))
    session = F.sum(begins.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slots = slots.withColumn("session", session).select(F.col("key").alias("_key"), F.col("slot").alias("_slot"), "session")
    met = rows.join(slots, F.col("key").eqNullSafe(F.col("_key")) & F.col("slot").eqNullSafe(F.col("_slot")))
    dealt = met.select("key", "session", "at", "id").repartition("key", "session").sortWithinPartitions("key", "session", "at", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hits = None, []
        for batch in batches:
            passed, waits = [], []
            for key, session, at in zip(*(batch.column(c).to_pylist() for c in ("key", "session", "at")), strict=True):
                if (key, session) != last:
                    last, hits = (key, session), []
                if at is None:
                    passed.append(None)
                    waits.append(None)
                    continue
                hits, ok, wait = allow(hits, at, window, limit)
                passed.append(ok)
                waits.append(wait)
            own = [batch.column(c) for c in ("key", "id", "at")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(passed, pa.bool_()), pa.array(waits, pa.int64())], names=["key", "id", "at", "allowed", "wait"])

    return dealt.mapInArrow(fold, OUT)


def limit_stream(stream: DataFrame, window: int, limit: int, delay: str | None = None) -> DataFrame:
    """The same over a stream, each key's hits held as state; a micro-batch's hits of a key are put in order as bare numbers.

    delay: hits so far behind the latest are left out, and a key is forgotten once the watermark is a window past its last
    hit, when its limiter is empty; None: no hit is late, and every key is kept.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        ids, ats = (np.concatenate(x) for x in zip(*((b["id"].to_numpy(), b["at"].to_numpy()) for b in batches), strict=True))
        order = np.lexsort((ids, ats))
        for k in range(0, len(order), CHUNK):
            rows = []
            for i in order[k : k + CHUNK]:
                at = int(ats[i])
                hits, ok, wait = allow(hits, at, window, limit)
                rows.append((key[0], int(ids[i]), at, ok, wait))
            yield pd.DataFrame(rows, columns=["key", "id", "at", "allowed", "wait"])
        state.update((hits,))
        if delay:
            state.setTimeoutTimestamp(max((hits[-1] + window) * 1000, state.getCurrentWatermarkMs()) + 1)

    rows, timeout = stream.select(F.col("key"), F.col("id"), F.col("at")), GroupStateTimeout.NoTimeout
    if delay:
        rows, timeout = rows.where("at is not null").withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", delay), GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(fold, OUT, "hits array<long>", "append", timeout)
