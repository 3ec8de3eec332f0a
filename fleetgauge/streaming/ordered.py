"""Rows of a stream handed to a function in event-time order, series by series, with keyed state.

Each series has its own entry in Spark's state store: what the function carries from row to row, the instant up to which the series
is settled, and the rows that still wait. A micro-batch reads and writes the entries of its own series only. A row waits until an
instant ``lateness`` ahead of it has been seen; an event-time timer settles what waits in series that receive nothing more. Rows that
come after their series was settled beyond them are not lost but marked late. What waits at the end of a run can be settled from the
state by a closing run, without touching the stream's checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import timedelta
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Gets what is carried (``None`` at first), the instant in microseconds and the values by name; returns what to carry on (of JSON's
#: types) and the output values by name, or ``None``.
Visit = Callable[[object, int, dict], tuple[object, dict | None]]

_STATE = "settled_at long, carried string, times array<long>, rows array<string>"
_MICRO = timedelta(microseconds=1)
SETTLED, LATE = "settled", "late"


def _rank(row: str) -> list:
    """Order of differing rows of one instant: nulls first, then by value."""
    return [(v is not None, v if v is not None else 0) for v in json.loads(row).values()]


class Series:
    """The state of one series."""

    def __init__(self, state: tuple | None):
        self.settled_at, carried, times, rows = state or (None, None, [], [])
        self.carried = None if carried is None else json.loads(carried)
        self.waiting = list(zip(map(int, times), rows, strict=True))

    def take(self, t: int, row: str) -> bool:
        """Let a row wait; false if the series is settled beyond it."""
        if self.settled_at is not None and t <= self.settled_at:
            return False
        self.waiting.append((t, row))
        return True

    def settle(self, mark: int | None, visit: Visit) -> Iterator[tuple[int, dict]]:
        """Visit the waiting rows up to ``mark`` (``None``: all) in order; of rows of one instant, the least."""
        ready = sorted((r for r in self.waiting if mark is None or r[0] <= mark), key=itemgetter(0))
        self.waiting = [] if mark is None else [r for r in self.waiting if r[0] > mark]
        for t, same in groupby(ready, itemgetter(0)):
            # Differing rows alone are ranked: repeats of a row are one, and most instants have one row.
            rows = list(dict.fromkeys(row for _, row in same))
            if t != self.settled_at:
                self.settled_at = t
                self.carried, out = visit(self.carried, t, json.loads(min(rows, key=_rank) if len(rows) > 1 else rows[0]))
                if out is not None:
                    yield t, out

    def dump(self) -> tuple:
        carried = None if self.carried is None else json.dumps(self.carried)
        return self.settled_at, carried, [t for t, _ in self.waiting], [r for _, r in self.waiting]


@dataclass(frozen=True)
class Ordered:
    """What is done with the rows of a series.

    ``id_cols`` tell series apart (nulls are values like any other), ``time_col`` is the instant (rows without one are ignored),
    ``values`` are the columns the function gets, ``out`` is the schema of what it returns. ``expiry``: event time without rows
    after which a series is forgotten (never, by default). Rows more than ``late_for`` later than ``lateness`` allows are dropped by
    the stream's watermark instead of being marked late.
    """

    id_cols: tuple[str, ...]
    time_col: str
    values: tuple[str, ...]
    visit: Visit
    out: T.StructType
    lateness: timedelta = timedelta(minutes=10)
    expiry: timedelta | None = None
    late_for: timedelta = timedelta(days=365)

    def _packed(self, rows: DataFrame) -> DataFrame:
        instant = F.col(self.time_col).cast("timestamp")
        packed = F.to_json(F.struct(*self.values), {"ignoreNullFields": "false"})
        return rows.filter(F.col(self.time_col).isNotNull()).select(*self.id_cols, instant.alias("_clock"), F.unix_micros(instant).alias("_t"), packed.alias("_row"))

    def _result(self, schema: T.StructType) -> T.StructType:
        ids = [T.StructField(c, schema[c].dataType) for c in self.id_cols]
        return T.StructType([*ids, T.StructField("_t", T.LongType()), T.StructField("_out", T.StringType()), T.StructField("kind", T.StringType())])

    def _unpacked(self, rows: DataFrame, time_type: T.DataType) -> DataFrame:
        found = rows.withColumn("_v", F.from_json("_out", self.out))
        return found.select(*self.id_cols, F.timestamp_micros("_t").cast(time_type).alias(self.time_col), "_v.*", *(["kind"] if "kind" in rows.columns else []))

    def stream(self, rows: DataFrame) -> DataFrame:
        """The streaming frame of settled output (``kind`` "settled") and late rows ("late", with the values they came with)."""
        visit, expiry, ids = self.visit, self.expiry, list(self.id_cols)
        lateness, behind = self.lateness // _MICRO, (self.lateness + self.late_for) // _MICRO

        def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            series = Series(state.get if state.exists else None)
            found: list[tuple[int, str, str]] = []
            newest = None
            for batch in batches:
                for t, row in zip(batch["_t"].tolist(), batch["_row"].tolist(), strict=True):
                    newest = t if newest is None else max(newest, t)
                    if not series.take(t, row):
                        found.append((t, row, LATE))
            clock = state.getCurrentWatermarkMs() * 1000
            seen = [clock + behind] if clock > 0 else []
            seen += [newest] if newest is not None else []
            if seen:
                found += [(t, json.dumps(out), SETTLED) for t, out in series.settle(max(seen) - lateness, visit)]
            # The stream's clock is that far behind the newest instant.
            due = min((t for t, _ in series.waiting), default=None)
            if due is None and expiry is not None and series.settled_at is not None:
                due = series.settled_at + expiry // _MICRO
            if due is not None and not series.waiting and clock > 0 and due + lateness <= clock + behind:
                state.remove()
            else:
                state.update(series.dump())
                if due is not None:
                    state.setTimeoutTimestamp(max((due + lateness - behind) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
            if found:
                columns = {c: [k] * len(found) for c, k in zip(ids, key, strict=True)}
                yield pd.DataFrame(columns | {"_t": [f[0] for f in found], "_out": [f[1] for f in found], "kind": [f[2] for f in found]})

        packed = self._packed(rows).withWatermark("_clock", f"{behind} microseconds")
        schema = self._result(packed.schema)
        out = packed.groupBy(*ids).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
        return out

    def start(self, rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Write the output of batch N to ``path/batches/batch=N``; a batch repeated after a failure replaces its own.

        What an earlier closing run wrote is withdrawn, as the stream will settle it.
        """
        spark, stream = rows.sparkSession, self.stream(rows)
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/tail")

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batches/batch={number}")

        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def close(self, rows: DataFrame, path: str, checkpoint: str) -> None:
        """Settle all that still waits in the state of a stopped stream into ``path/tail``; the state stays as it is.

        ``rows`` is the stream's input, of which only the schema is used.
        """
        schema, visit, ids = self._result(self._packed(rows).schema), self.visit, list(self.id_cols)
        state = rows.sparkSession.read.format("statestore").load(checkpoint)
        held = state.select(*[F.col("key")[c].alias(c) for c in ids], F.col("value.groupState.*"))

        def settle(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for *key, settled_at, carried, times, waiting in batch.itertuples(index=False):
                    series = Series((None if pd.isna(settled_at) else int(settled_at), carried, times, waiting))
                    found += [(*key, t, json.dumps(out), SETTLED) for t, out in series.settle(None, visit)]
                if found:
                    yield pd.DataFrame(found, columns=[*ids, "_t", "_out", "kind"])

        held.filter("size(times) > 0").mapInPandas(settle, schema).write.mode("overwrite").parquet(f"{path}/tail")

    def _read(self, spark: SparkSession, path: str, schema: T.StructType, kind: str) -> DataFrame:
        result = self._result(schema)
        batches = spark.read.schema(T.StructType([*result, T.StructField("batch", T.LongType())])).parquet(f"{path}/batches")
        tail = spark.read.schema(result).parquet(f"{path}/tail")
        return batches.select(*result.names).unionByName(tail).filter(F.col("kind") == kind).drop("kind")

    def settled(self, rows: DataFrame, path: str) -> DataFrame:
        """Everything settled so far, the closing run included: the series, the instant and the output."""
        return self._unpacked(self._read(rows.sparkSession, path, rows.schema, SETTLED), rows.schema[self.time_col].dataType)

    def late(self, rows: DataFrame, path: str) -> DataFrame:
        """The rows that came too late: the series, the instant and the values."""
        found = self._read(rows.sparkSession, path, rows.schema, LATE)
        values = T.StructType([rows.schema[c] for c in self.values])
        instant = F.timestamp_micros("_t").cast(rows.schema[self.time_col].dataType).alias(self.time_col)
        return found.withColumn("_v", F.from_json("_out", values)).select(*self.id_cols, instant, "_v.*")


def ordered(id_cols: Sequence[str], time_col: str, values: Sequence[str], visit: Visit, out: T.StructType, **options) -> Ordered:
    return Ordered(tuple(id_cols), time_col, tuple(values), visit, out, **options)
