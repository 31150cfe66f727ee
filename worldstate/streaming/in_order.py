"""One step over rows in order of time, a key at a time: over tables, and over streams whatever the order of arrival."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
PLAIN = {"string": str, "long": int, "int": int, "boolean": bool, "double": float}
#: Settings that a stream with such a fold needs: where its state is kept.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass
class Fold:
    """step(state, row) -> (state, results): row by column name, one tuple of the columns of `gives`.

    A state is None at first, and made of what JSON has. columns and gives map names to types of Spark; key: columns that
    rows are dealt by; at: a column of microseconds. Rows are in order of `at` and the columns after the key, as they stand.
    """

    step: Callable[[Any, dict], tuple[Any, tuple]]
    key: list[str]
    columns: dict[str, str]
    gives: dict[str, str]
    at: str = "at"
    order: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.order = [self.at, *(c for c in self.columns if c not in (*self.key, self.at))]

    def _typed(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c).cast(t).alias(c) for c, t in self.columns.items()))

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in self.gives.items())

    def over_table(self, df: DataFrame) -> DataFrame:
        """A key's rows pass through one task in order; that task holds one state. Without a time they come first."""
        names, types, step, key = list(self.gives), [ARROW[t] for t in self.gives.values()], self.step, self.key

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, state = object(), None
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    own = tuple(row[c] for c in key)
                    if own != last:
                        last, state = own, None
                    state, out = step(state, row)
                    rows.append(out)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        dealt = self._typed(df).repartition(*self.key).sortWithinPartitions(*self.key, *self.order)
        return dealt.mapInArrow(fold, self.schema)

    def over_stream(self, df: DataFrame, delay: str) -> DataFrame:
        """The same rows from a stream, once the watermark, `delay` behind the latest row, has passed them.

        Rows still further behind, or without a time, are left out. Needs the settings of STATE_STORE.
        """
        timed = self._typed(df).where(F.col(self.at).isNotNull()).withColumn("_ts", F.timestamp_micros(self.at)).withWatermark("_ts", delay)
        return timed.groupBy(*self.key).transformWithStateInPandas(InOrder(self), self.schema, "append", "EventTime")


class InOrder(StatefulProcessor):
    """A key's rows wait in a list; a timer for each moment folds those that are due, in order."""

    def __init__(self, fold: Fold) -> None:
        self.fold = fold
        self.names = [c for c in fold.columns if c not in fold.key]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {self.fold.columns[c]}" for c in self.names))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for frame in rows:
            # pandas makes floats of whole numbers beside nulls
            columns = [[None if pd.isna(x) else PLAIN[self.fold.columns[c]](x) for x in frame[c]] for c in self.names]
            for row in zip(*columns, strict=True):
                due = row[self.names.index(self.fold.at)] // 1000 + 1
                if due not in known:
                    self.handle.registerTimer(due)
                    known.add(due)
                self.waiting.appendValue(row)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = int(expiredTimerInfo.getExpiryTimeInMs()) * 1000
        waiting = [dict(zip(self.names, x, strict=True)) for x in self.waiting.get()]
        at = self.fold.at
        due = sorted((x for x in waiting if x[at] < until), key=lambda x: [(x[c] is not None, x[c]) for c in self.fold.order])
        if not due:
            return
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        rows, own = [], dict(zip(self.fold.key, key, strict=True))
        for row in due:
            state, out = self.fold.step(state, row | own)
            rows.append(out)
        self.state.update((json.dumps(state),))
        left = [tuple(x[c] for c in self.names) for x in waiting if x[at] >= until]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype="Int64" if t in ("long", "int") else object) for k, (c, t) in enumerate(self.fold.gives.items())})

    def close(self) -> None:
        pass
