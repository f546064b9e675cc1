"""Folds over a key's rows in the order of their event time, whatever order they come in."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keyed list states and timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as ordered folds need; the session's own setting is put back after it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class OrderedFold(StatefulProcessor):
    """Holds rows until the watermark has passed them, then folds them by (time, tie), and forgets a key that stays silent.

    fold(state or None, value) -> state, a tuple of state_schema; result(state) -> the output row after the key.
    """

    def __init__(self, key: str, columns: list[str], state_schema: str, fold, result, idle_ms: int):
        self.key, self.columns, self.state_schema, self.fold, self.result, self.idle_ms = key, columns, state_schema, fold, result, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"last bigint, {self.state_schema}")
        self.waiting = handle.getListState("waiting", "at bigint, tie bigint, value double")

    def _wake(self, micros: int) -> None:
        """One timer, at the first millisecond whose watermark passes the given time; an earlier one stays."""
        at = -(-micros // 1000)
        timers = list(self.handle.listTimers())
        if any(t <= at for t in timers):
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of Spark's interface
        first = None
        for pdf in rows:
            own = list(zip(pdf["fold_at"].tolist(), pdf["fold_tie"].tolist(), pdf["fold_value"].tolist(), strict=True))
            self.waiting.appendList(own)
            first = min([x[0] for x in own] + [first] * (first is not None))
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        last, *state = self.state.get() if self.state.exists() else (None, None)
        state = tuple(state) if last is not None else None
        if ready:
            for at, _, value in ready:
                state = self.fold(state if last is not None and at - last <= self.idle_ms * 1000 else None, value)
                last = at
            self.state.update((last, *state))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if rest:
            self._wake(min(r[0] for r in rest))
        elif last is not None and last + self.idle_ms * 1000 > passed:
            self._wake(last + self.idle_ms * 1000)
        elif last is not None:
            self.state.clear()
        if ready:
            yield pd.DataFrame([(*key, *self.result(state))], columns=self.columns)

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, key: str, value, order: str, tie, state_schema: str, fold, result, schema: str, late: str, idle_seconds: float) -> DataFrame:
    """(key, *schema) after every release of a key, in update mode; start the query inside keyed_state.

    A row waits until the watermark, the newest time less `late`, has passed it; rows at or behind the watermark when they come are
    late and are dropped, which Spark counts in the query's progress. Equal times go by tie, then by value. Rows without a time wait
    for nothing and are left out. A key starts anew
    with a row more than `idle_seconds` after its last, and is forgotten once the watermark is so far.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where(F.col(order).isNotNull()).withWatermark(order, late).select(key, order, F.unix_micros(F.col(order).cast("timestamp")).alias("fold_at"), tie.cast("bigint").alias("fold_tie"), value.cast("double").alias("fold_value"))
    columns = [key, *(c.split()[0] for c in schema.split(", "))]
    step = OrderedFold(key, columns, state_schema, fold, result, int(idle_seconds * 1000))
    return rows.groupBy(key).transformWithStateInPandas(step, f"{key} {kind}, {schema}", "Update", "EventTime")
