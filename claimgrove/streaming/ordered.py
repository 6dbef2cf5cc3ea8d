"""Rows of a stream judged in event-time order, whatever micro-batch brings them.

Each key buffers its rows in a list state until the watermark has passed them, so that no earlier row can
still come. An event-time timer then releases them in order to a fold that carries a small state per
key. A second timer clears a key that has been idle for `idle`. Rows behind the watermark are dropped by Spark
and counted (`late_rows`); with them, released and waiting rows add up to the input.

The state store must be RocksDB (`STATE_STORE`): appending to a list there does not rewrite it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}
# Microseconds of a row's event time, beside its columns.
AT = "event_micros"


def plain(value):
    """A value of a pandas cell as the state stores it."""
    if value is None or value is pd.NaT or (not isinstance(value, (list, str, bytes)) and pd.isna(value)):
        return None
    return value.item() if hasattr(value, "item") else value


class EventOrder(StatefulProcessor):
    """Buffers rows, releases them by the watermark and folds them in the order of `by`."""

    def __init__(
        self, rows: StructType, held: StructType, by: Sequence[str], fold: Callable, out: Sequence[str], idle: int
    ):
        self.rows, self.held_schema, self.fold, self.out, self.idle = rows, held, fold, list(out), idle
        names = rows.fieldNames()
        self.at = names.index(AT)
        self.by = [names.index(c) for c in by]
        whole = {f.name for f in rows.fields if f.dataType.typeName() in ("integer", "long", "short")}
        self.whole = [n in whole for n in names]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.held = handle.getValueState("held", self.held_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            cells = [[plain(v) for v in batch[c]] for c in self.rows.fieldNames()]
            cells = [[None if v is None else int(v) for v in c] if w else c for c, w in zip(cells, self.whole)]
            taken = list(zip(*cells))
            if taken:
                self.waiting.appendList(taken)
                least = min(row[self.at] for row in taken)
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, micros: int) -> None:
        """One timer per key, at the least time that waits."""
        ms = micros // 1000 + 1
        timers = list(self.handle.listTimers())
        if not timers or min(timers) > ms:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[self.at] <= passed]
        later = [r for r in rows if r[self.at] > passed]
        if not rows:  # idle
            self.held.clear()
            return iter(())
        self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(min(r[self.at] for r in later) // 1000 + 1)
        elif ready:
            self.handle.registerTimer(max(max(r[self.at] for r in ready), passed) // 1000 + self.idle)
        if not ready:
            return iter(())
        ready.sort(key=lambda r: [(r[i] is not None, r[i]) for i in self.by])
        held, results = self.fold(tuple(self.held.get()) if self.held.exists() else None, ready)
        self.held.update(held)
        return iter([pd.DataFrame(results, columns=self.out).astype(object)])


def in_event_order(
    df: DataFrame,
    key: Sequence[str],
    time: str,
    columns: Sequence[str],
    by: Sequence[str],
    fold: Callable,
    held: str,
    results: str,
    lateness: str,
    idle: str,
) -> DataFrame:
    """key, time, `columns` and the `results` of `fold` for every row, judged in the order of (`by`).

    `fold(held, rows)` gets what the key holds (or None) and the released rows in order, each a tuple of
    key, time, columns and microseconds; it returns what to hold and a row of key, time, columns and results
    for each. `by` may name the time by AT. A key's order is final once the watermark has passed.
    """
    spark = df.sparkSession
    names = [*key, time, *columns]
    rows = df.withWatermark(time, lateness).select(*names, F.unix_micros(time).alias(AT))
    kept = StructType([f for f in rows.schema.fields if f.name != time])
    added = StructType.fromDDL(results)
    out = StructType([f for f in rows.schema.fields if f.name not in (time, AT)])
    out = StructType([*out.fields, StructField(AT, LongType()), *added.fields])
    held_type = StructType.fromDDL(held)
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    processor = EventOrder(
        kept, held_type, by, fold, out.fieldNames(), int(pd.Timedelta(idle).total_seconds() * 1000)
    )
    judged = rows.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime"
    )
    moment = F.timestamp_micros(AT).alias(time)
    return judged.select(*key, moment, *columns, *added.fieldNames())


def late_rows(query) -> int:
    """Rows of a finished or running query that came behind the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
