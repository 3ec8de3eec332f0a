"""The same diagnostics over telemetry that keeps arriving."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetgauge import KEYS
from fleetgauge.functions.expressions import XID_LIMIT, age_seconds, percent
from fleetgauge.functions.frames import FINDING_COLUMNS, Rule, findings, text
from fleetgauge.operators.performance import checkpointer_stats
from fleetgauge.operators.sessions import is_idle_in_transaction, is_long_query, is_long_transaction
from fleetgauge.streaming.ordered import Ordered, Visit, ordered


def activity_alerts(activity: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Long queries, idle transactions and long transactions, in one pass. Batch or stream alike."""
    pid = F.col("pid")
    query_age, transaction_age = age_seconds("snapshot_ts", "query_start"), age_seconds("snapshot_ts", "xact_start")

    def alert(rule: str, when: Column, age: Column, what: str) -> Rule:
        return Rule(rule, when, "warning", pid, age, text("pid ", pid, what, age, "s"))

    rules = [
        alert("long_query", is_long_query(), query_age, " runs for "),
        alert("idle_transaction", is_idle_in_transaction(), transaction_age, " idle for "),
        alert("long_transaction", is_long_transaction(), transaction_age, " in transaction for "),
    ]
    return findings(activity.filter(F.col("backend_type") == "client backend"), "alerts", rules, keys)


def _checkpointer_rule() -> Rule:
    warn = F.col("checkpointer_status") == "WARNING"
    return Rule("checkpointer", warn, "warning", F.lit("checkpointer"), F.col("write_time_ms"), text("checkpointer needs attention"))


def checkpointer_alerts(checkpointer: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return findings(checkpointer_stats(checkpointer, keys), "alerts", [_checkpointer_rule()], keys)


def _wraparound_rule(threshold: float) -> Rule:
    used = percent("xid_age", F.lit(XID_LIMIT))
    return Rule("wraparound", used > threshold, "critical", F.col("datname"), used, text(F.col("datname"), " nears wraparound"))


def wraparound_alerts(databases: DataFrame, threshold: float = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    return findings(databases.filter("datallowconn"), "alerts", [_wraparound_rule(threshold)], keys)


def _growth(carried: list | None, t: int, values: dict) -> tuple[list, dict | None]:
    """Growth since the row before; a counter that fell was reset, so its new value counts."""
    if carried is None:
        return [t, values], None
    start, before = carried
    grown = {c: v if v is None or before[c] is None or v < before[c] else v - before[c] for c, v in values.items()}
    return [t, values], {"interval_start": start, **grown}


def counter_deltas(
    stream: DataFrame,
    id_cols: Sequence[str],
    counters: Sequence[str],
    time_col: str = "snapshot_ts",
    lateness: timedelta = timedelta(minutes=10),
    expiry: timedelta | None = None,
) -> CounterDeltas:
    """Counter growth between consecutive snapshots of each series, in event-time order.

    Snapshots wait in their series' state until an instant ``lateness`` ahead has been seen, by the series itself or by the stream;
    later ones go to the side table :meth:`CounterDeltas.late`. Differing snapshots of one instant count as the least of them, column
    by column from the first. ``expiry`` forgets series that have been silent for so long; their next snapshot starts anew.
    """
    out = T.StructType([T.StructField("interval_start", T.LongType()), *[stream.schema[c] for c in counters]])
    return CounterDeltas(ordered(id_cols, time_col, counters, _growth, out, lateness=lateness, expiry=expiry), stream)


@dataclass(frozen=True)
class CounterDeltas:
    """A stream of counter growth: start it, close it, read what it has given."""

    order: Ordered
    stream: DataFrame

    def start(self, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
        return self.order.start(self.stream, path, checkpoint, once)

    def close(self, path: str, checkpoint: str) -> None:
        """Settle the waiting snapshots of a stopped stream; a stream started again settles them itself."""
        self.order.close(self.stream, path, checkpoint)

    def growth(self, path: str) -> DataFrame:
        ids, time_col, counters = self.order.id_cols, self.order.time_col, self.order.values
        start = F.timestamp_micros("interval_start").cast(self.stream.schema[time_col].dataType).alias("interval_start")
        return self.order.settled(self.stream, path).select(*ids, start, F.col(time_col).alias("interval_end"), *counters)

    def late(self, path: str) -> DataFrame:
        return self.order.late(self.stream, path)


_FINDING = T.StructType([T.StructField(c, T.DoubleType() if c == "metric" else T.StringType()) for c in FINDING_COLUMNS])


def _episode_start(quiet_us: int | None) -> Visit:
    def visit(carried: list | None, t: int, values: dict) -> tuple[list, dict | None]:
        hit, finding = values["_hit"], {c: values[c] for c in FINDING_COLUMNS}
        ongoing = carried is not None and carried[0] and (quiet_us is None or t - carried[1] <= quiet_us)
        return [hit, t], finding if hit and not ongoing else None

    return visit


@dataclass(frozen=True)
class EpisodeAlerts:
    """One alert per episode: the first snapshot, in event-time order, at which a subject fulfils a rule.

    An episode ends with a snapshot that does not fulfil it, or after ``quiet`` without one that does. Repeated and late snapshots
    give no alert.
    """

    order: Ordered
    stream: DataFrame

    def start(self, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
        return self.order.start(self.stream, path, checkpoint, once)

    def close(self, path: str, checkpoint: str) -> None:
        self.order.close(self.stream, path, checkpoint)

    def alerts(self, path: str) -> DataFrame:
        return self.order.settled(self.stream, path).select(*self.order.id_cols[:-2], self.order.time_col, *FINDING_COLUMNS)


def episodes(
    rows: DataFrame,
    rule: Rule,
    keys: Sequence[str] = ("cluster_id",),
    time_col: str = "snapshot_ts",
    lateness: timedelta = timedelta(minutes=10),
    quiet: timedelta | None = None,
    expiry: timedelta | None = None,
) -> EpisodeAlerts:
    """The episodes of a rule over a stream of snapshots, per ``keys`` and subject of the rule."""
    cells = {
        "source": F.lit("alerts"),
        "rule": F.lit(rule.name),
        "severity": F.lit(rule.severity),
        "subject": rule.subject.cast("string"),
        "metric": rule.metric.cast("double"),
        "message": rule.message.cast("string"),
    }
    marked = rows.select(
        *keys,
        time_col,
        F.coalesce(rule.when, F.lit(False)).alias("_hit"),
        *[c.alias(n) for n, c in cells.items()],
        F.lit(rule.name).alias("_rule"),
        cells["subject"].alias("_subject"),
    )
    visit = _episode_start(None if quiet is None else quiet // timedelta(microseconds=1))
    order = ordered([*keys, "_rule", "_subject"], time_col, ["_hit", *FINDING_COLUMNS], visit, _FINDING, lateness=lateness, expiry=expiry)
    return EpisodeAlerts(order, marked)


def checkpointer_episodes(checkpointer: DataFrame, keys: Sequence[str] = ("cluster_id",), **options) -> EpisodeAlerts:
    """:func:`checkpointer_alerts` over a stream, one per episode."""
    rows = checkpointer_stats(checkpointer, [*keys, "snapshot_ts"])
    return episodes(rows, _checkpointer_rule(), keys, **options)


def wraparound_episodes(databases: DataFrame, threshold: float = 50, keys: Sequence[str] = ("cluster_id",), **options) -> EpisodeAlerts:
    """:func:`wraparound_alerts` over a stream, one per episode and database."""
    return episodes(databases.filter("datallowconn"), _wraparound_rule(threshold), keys, **options)


def per_batch(
    stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Run a batch operator on every micro-batch and append its rows to ``path``.

    The batch number is part of the folder, so a batch that is repeated after a failure replaces its
    own output instead of adding to it.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
