"""The streaming face, driven to completion over the event table."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from fleetgauge.queries.registry import CLIENT, K, age, pct, query, rule
from fleetgauge.queries.performance import checkpointer, checkpointer_view
from fleetgauge.session import shared_dir
from fleetgauge.sources.derive import TEXTS, Telemetry, _spark_sql, _without_zone
from fleetgauge.streaming import live as S


def _fresh_dir(t: Telemetry, name: str) -> str:
    """A new folder that all executors reach."""
    return f"{shared_dir(t.spark)}/fleetgauge-{name}-{uuid.uuid4().hex}"


def _activity_stream(t: Telemetry):
    """The activity telemetry as a stream: the same derivation over streamed events."""
    events = (
        t.spark.readStream.schema(t["events"].schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    )
    assert "t_activity" in TEXTS
    return _without_zone(t.spark.sql(_spark_sql("t_activity"), events=events))


def _alert(name: str, age_of: str, what: str, where: str) -> str:
    a = age("snapshot_ts", age_of)
    return rule("alerts", name, "warning", "pid", a, f"'pid ' || pid || '{what}' || {a} || 's'", f"FROM t_activity WHERE {CLIENT} AND {where}")


_ALERTS = " UNION ALL ".join(
    [
        _alert("long_query", "query_start", " runs for ", "state = 'active' AND query_start < snapshot_ts - INTERVAL 5 MINUTE"),
        _alert("idle_transaction", "xact_start", " idle for ", "state = 'idle in transaction' AND xact_start < snapshot_ts - INTERVAL 1 MINUTE"),
        _alert("long_transaction", "xact_start", " in transaction for ", "state <> 'idle' AND xact_start < snapshot_ts - INTERVAL 1 HOUR"),
    ]
)


@query("live_activity_alerts_batch", ["t_activity"], _ALERTS)
def _(t):
    return S.activity_alerts(t["t_activity"])


@query("live_activity_alerts_stream", ["t_activity"], _ALERTS)
def _(t):
    out, mark = _fresh_dir(t, "alerts"), _fresh_dir(t, "alerts-progress")
    S.per_batch(_activity_stream(t), S.activity_alerts, out, mark, once=True).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


@query(
    "live_checkpointer_alerts",
    ["t_counters"],
    rule("alerts", "checkpointer", "warning", "'checkpointer'", "write_time_ms", "'checkpointer needs attention'",
         "FROM t_counters WHERE (checkpoints_timed > 0 AND checkpoints_req > checkpoints_timed * 2) OR write_time_ms > 10000 OR sync_time_ms > 10000"),
)
def _(t):
    return S.checkpointer_alerts(checkpointer(t))


_XID = pct("xid_age", "2147483647")


@query(
    "live_wraparound_alerts",
    ["t_databases"],
    rule("alerts", "wraparound", "critical", "datname", _XID, "datname || ' nears wraparound'", f"FROM t_databases WHERE datallowconn AND {_XID} > 50"),
)
def _(t):
    return S.wraparound_alerts(t["t_databases"])


def _user_totals(t: Telemetry):
    """A per-user running counter: one snapshot per event, the event number as the counter."""
    events = (
        t.spark.readStream.schema(t["events"].schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    )
    return events.select(
        F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("cluster_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"),
        F.col("ts").alias("snapshot_ts"),
        F.col("event_id").alias("events_total"),
    )


_GROWTH = """SELECT cluster_id, name, interval_start, interval_end, CASE WHEN events_total < b THEN events_total ELSE events_total - b END AS events_total FROM (
  SELECT *, lag(events_total) OVER w AS b, lag(snapshot_ts) OVER w AS interval_start, snapshot_ts AS interval_end FROM (SELECT 'c' || user_id % 5 AS cluster_id, 'user' || user_id AS name, ts AS snapshot_ts, min(event_id) AS events_total FROM events GROUP BY ALL)
  WINDOW w AS (PARTITION BY cluster_id, name ORDER BY snapshot_ts))
WHERE b IS NOT NULL"""


def _run_to_end(t: Telemetry, live, name: str) -> str:
    """Drive a stream over all there is, then close it; the folder of its output."""
    out, mark = _fresh_dir(t, name), _fresh_dir(t, f"{name}-progress")
    live.start(out, mark, once=True).awaitTermination()
    live.close(out, mark)
    return out


@query("live_counter_deltas_stream", [], _GROWTH)
def _(t):
    deltas = S.counter_deltas(_user_totals(t), ["cluster_id", "name"], ["events_total"])
    return deltas.growth(_run_to_end(t, deltas, "deltas"))


def _replayed(t: Telemetry, name: str):
    """A derived table as a stream that comes in several batches, every snapshot of even clusters twice."""
    folder = _fresh_dir(t, f"replay-{name}")
    rows = t[name]
    rows.unionByName(rows.filter("cast(substring(cluster_id, 2) as int) % 2 = 0")).repartition(4, "snapshot_ts").write.parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _episodes(base: str, series: str) -> str:
    """The alerts of ``base`` (which has all snapshots and ``hit``) that start an episode."""
    return f"""SELECT cluster_id, snapshot_ts, 'alerts' AS source, rule, severity, subject, metric, message FROM (
  SELECT *, lag(hit) OVER (PARTITION BY {series} ORDER BY snapshot_ts) AS before FROM ({base}) s) e WHERE hit AND NOT coalesce(before, false)"""


@query(
    "live_checkpointer_alerts_stream",
    ["t_counters"],
    _episodes(
        """SELECT cluster_id, snapshot_ts, 'checkpointer' AS rule, 'warning' AS severity, 'checkpointer' AS subject,
          CAST(write_time_ms AS DOUBLE) AS metric, 'checkpointer needs attention' AS message,
          coalesce((checkpoints_timed > 0 AND checkpoints_req > checkpoints_timed * 2) OR write_time_ms > 10000 OR sync_time_ms > 10000, false) AS hit
        FROM t_counters""",
        "cluster_id",
    ),
)
def _(t):
    # Snapshots are a day apart, and a batch of files may be weeks ahead of the next.
    live = S.checkpointer_episodes(checkpointer_view(_replayed(t, "t_counters")), lateness=timedelta(days=400))
    return live.alerts(_run_to_end(t, live, "checkpointer-alerts"))


@query(
    "live_wraparound_alerts_stream",
    ["t_databases"],
    _episodes(
        f"""SELECT cluster_id, snapshot_ts, 'wraparound' AS rule, 'critical' AS severity, datname AS subject, {_XID} AS metric,
          datname || ' nears wraparound' AS message, coalesce({_XID} > 50, false) AS hit FROM t_databases WHERE datallowconn""",
        "cluster_id, subject",
    ),
)
def _(t):
    live = S.wraparound_episodes(_replayed(t, "t_databases"), lateness=timedelta(days=4000))
    return live.alerts(_run_to_end(t, live, "wraparound-alerts"))
