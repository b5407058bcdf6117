"""Folds over streams whose rows come late and out of order: rows wait in keyed state until the watermark has passed them.

The session's state store must be RocksDB's
(`spark.sql.streaming.stateStore.providerClass`), which transformWithState needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import folds


class _Ordered(StatefulProcessor):
    """Waiting rows by event time and arrival; one event-time timer for each time that has rows; the machine's state beside them."""

    def __init__(self, machine, key: str, kind: str, columns: list[str], schema: T.StructType, ttl_ms: int | None):
        self.machine, self.key, self.kind, self.columns, self.schema, self.ttl_ms = machine, key, kind, columns, schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms bigint", "rows string", self.ttl_ms)
        self.held = handle.getValueState("machine", "state string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list] = {}
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[ms]").astype("int64")
            for ms, row in zip(at.tolist(), pdf[self.columns].astype(object).where(pdf[self.columns].notna(), None).values.tolist(), strict=True):
                new.setdefault(ms, []).append(row)
        for ms, found in new.items():
            old = json.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            self.waiting.updateValue((ms,), (json.dumps(old + found, default=float),))
            if not old:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= ms)
        rows = [r for k in due for r in json.loads(self.waiting.getValue((k,))[0])]
        for k in due:
            self.waiting.removeKey((k,))
        if not rows:
            return
        state = json.loads(self.held.get()[0]) if self.held.exists() else self.machine.start()
        state, out = folds._fold(self.machine, state, pd.DataFrame(rows, columns=self.columns))
        self.held.update((json.dumps(state, default=lambda a: a.tolist()),))
        made = pd.DataFrame(out, columns=folds._names(self.machine))
        made.insert(0, self.key, key[0])
        yield made

    def close(self) -> None:
        pass


def fold_late(rows: DataFrame, machine, key: str, delay: str, ttl_ms: int | None = None) -> DataFrame:
    """A key's rows in the order of their event times `ts`, then frames, through the machine, as `folds.fold` gives them for a batch.

    A row waits until the watermark, `delay` behind the latest event time, has passed it; rows that come later still are
    dropped. State that is not touched for `ttl_ms` milliseconds goes.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(f"{key} {kind}, {machine.output}")
    columns = list(machine.columns)
    timed = rows.select(key, "ts", *columns).withWatermark("ts", delay)
    return timed.groupBy(key).transformWithStateInPandas(_Ordered(machine, key, kind, columns, schema, ttl_ms), schema, "Append", "EventTime")
