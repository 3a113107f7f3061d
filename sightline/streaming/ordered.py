"""Keyed stream processing in event order: rows wait until the watermark has passed them."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def carry_code() -> None:
    """Pickle this package's classes by value: the driver's streaming worker starts without it."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__.split(".")[0]])


class InOrder(StatefulProcessor):
    """Buffers each key's rows and hands them on sorted, once no earlier row can arrive.

    Subclasses state the input ``columns`` (``ts`` first), the ``order`` within
    equal times (its first column a number or ``ts``), and implement ``start``, ``advance`` and
    ``forget``. A key that has been idle for ``idle_ms`` of event time loses its state.

    However many rows a key has in one batch, they are never in memory at once: they are held as
    sorted pieces of up to ``piece`` rows, each under the span it covers, and merged from these.
    ``advance`` takes the sorted rows in frames that no value of the first order column spans.
    """

    columns = "ts TIMESTAMP"
    order: tuple = ("ts",)
    idle_ms = 60_000
    piece = 2000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.strip().split(" ")[0] for c in self.columns.split(",")]
        self.head = handle.getValueState("head", "newest BIGINT, earliest BIGINT, parts BIGINT")
        self.pieces = handle.getMapState(
            "pieces", "low DOUBLE, part BIGINT, first_ms BIGINT, last_ms BIGINT", "rows BINARY"
        )
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None: ...

    def advance(self, key, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def forget(self) -> None: ...

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, earliest, self.parts = self.head.get() or (None, None, 0)
        for pdf in rows:
            pdf = pdf[self.names]
            ms = self._ms(pdf)
            newest = max(int(ms.max()), newest) if newest is not None else int(ms.max())
            earliest = min(int(ms.min()), earliest) if earliest is not None else int(ms.min())
            self._hold(pdf, ms)
        yield from self._advance(key, newest, earliest, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, earliest, self.parts = self.head.get() or (None, None, 0)
        yield from self._advance(key, newest, earliest, timerValues)

    def _ms(self, rows: pd.DataFrame) -> np.ndarray:
        """Times rounded up, so that nothing within the same millisecond is still to come."""
        us = pd.to_datetime(rows["ts"]).to_numpy().astype("datetime64[us]").astype(np.int64)
        return -(-us // 1000)

    def _lead(self, rows: pd.DataFrame, ms: np.ndarray) -> np.ndarray:
        """The first order column as numbers; rows without one come last."""
        if self.order[0] == "ts":
            return ms.astype(float)
        lead = pd.to_numeric(rows[self.order[0]]).to_numpy(float)
        return np.where(np.isnan(lead), np.inf, lead)

    def _hold(self, rows: pd.DataFrame, ms: np.ndarray) -> None:
        lead = self._lead(rows, ms)
        at = np.argsort(lead, kind="stable")
        for i in range(0, len(at), self.piece):
            some = at[i : i + self.piece]
            batch = pa.RecordBatch.from_pandas(rows.iloc[some], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            span = int(ms[some].min()), int(ms[some].max())
            self.pieces.updateValue((float(lead[some[0]]), self.parts, *span), (sink.getvalue().to_pybytes(),))
            self.parts += 1

    def _ready(self, due: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        """Rows of the pieces up to ``now`` in order; what they hold of later rows is put back.

        Pieces are taken by where they start. All rows before the start of the next one are complete.
        """
        pool, size = [], 0
        for n, at in enumerate(due):
            rows = pa.ipc.open_stream(self.pieces.getValue(at)[0]).read_pandas()
            self.pieces.removeKey(at)
            if at[3] > now:
                ms = self._ms(rows)
                self._hold(rows[ms > now], ms[ms > now])
                rows = rows[ms <= now]
            pool.append(rows)
            end = due[n + 1][0] if n + 1 < len(due) else None
            # What stayed in the pool is gone through again only when as much has come in.
            if end is not None and sum(map(len, pool[1:])) < size:
                continue
            rows = pd.concat(pool, ignore_index=True) if len(pool) > 1 else rows
            whole = np.full(len(rows), True) if end is None else self._lead(rows, self._ms(rows)) < end
            pool = [rows[~whole]]
            size = len(pool[0])
            if whole.any():
                yield rows[whole].sort_values(list(self.order), kind="stable", ignore_index=True)

    def _advance(self, key, newest, earliest, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs()
        if earliest is not None and earliest <= now:
            held = sorted(self.pieces.keys())
            due = [at for at in held if at[2] <= now]
            before = self.parts
            yield from self.advance(key, self._ready(due, now))
            wait = [at[2] for at in held if at[2] > now]
            if self.parts > before:
                wait = [at[2] for at in self.pieces.keys()]
            earliest = min(wait, default=None)
        if newest is None:
            newest = now
        if earliest is not None:
            self.head.update((newest, earliest, self.parts))
            self.handle.registerTimer(earliest)
        elif now >= newest + self.idle_ms:
            self.head.clear()
            self.forget()
        else:
            self.head.update((newest, None, self.parts))
            self.handle.registerTimer(newest + self.idle_ms)

    def close(self) -> None: ...
