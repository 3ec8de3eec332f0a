"""Sessions, locks, replication."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import replication as R
from fleetgauge.operators import sessions as S
from fleetgauge.queries.registry import CLIENT, K, age, lsn, pretty, query, rule, setting, top


@query(
    "s1_long_running_queries",
    ["t_activity"],
    f"""SELECT {K}, pid, {age('snapshot_ts', 'query_start')} AS duration_seconds, usename, datname, state, query FROM t_activity
WHERE state = 'active' AND {CLIENT} AND query_start < snapshot_ts - INTERVAL 5 MINUTE""",
)
def _(t):
    return S.long_running_queries(t["t_activity"])


@query(
    "s2_idle_in_transaction",
    ["t_activity"],
    f"""SELECT {K}, pid, {age('snapshot_ts', 'xact_start')} AS transaction_seconds, usename, datname, state FROM t_activity
WHERE state = 'idle in transaction' AND {CLIENT} AND xact_start < snapshot_ts - INTERVAL 1 MINUTE""",
)
def _(t):
    return S.idle_in_transaction(t["t_activity"])


@query(
    "s3_long_running_transactions",
    ["t_activity"],
    f"""SELECT {K}, pid, usename, datname, state, {age('snapshot_ts', 'xact_start')} AS transaction_seconds, query FROM t_activity
WHERE state <> 'idle' AND xact_start IS NOT NULL AND {CLIENT} AND snapshot_ts - xact_start > INTERVAL 6 HOUR""",
)
def _(t):
    return S.long_running_transactions(t["t_activity"], threshold_hours=6)


@query(
    "s4_long_running_prepared",
    ["t_prepared_xacts"],
    f"""SELECT {K}, gid, owner, database, prepared, {age('snapshot_ts', 'prepared')} AS duration_seconds, transaction FROM t_prepared_xacts
WHERE snapshot_ts - prepared > INTERVAL 1 HOUR""",
)
def _(t):
    return S.long_running_prepared(t["t_prepared_xacts"])


@query(
    "s5_connection_usage",
    ["t_activity", "t_settings"],
    f"""SELECT {K}, used_connections, {setting('max_connections', 'BIGINT')} AS max_connections FROM (
  SELECT {K}, count(*) FILTER (WHERE {CLIENT}) AS used_connections FROM t_activity GROUP BY {K}) r""",
)
def _(t):
    return S.connection_usage(t["t_activity"], t["t_settings"])


_SAME_OBJECT = " AND ".join(
    ["o.cluster_id = w.cluster_id", "o.snapshot_ts = w.snapshot_ts", "o.locktype = w.locktype"]
    + [f"o.{c} IS NOT DISTINCT FROM w.{c}" for c in S.LOCK_OBJECT]
    + ["o.pid <> w.pid"]
)


@query(
    "s6_lock_waiters",
    ["t_locks", "t_activity"],
    f"""SELECT w.cluster_id, w.snapshot_ts, w.pid AS blocked_pid, wa.usename AS blocked_user, wa.query AS blocked_query,
  o.pid AS blocking_pid, oa.usename AS blocking_user, oa.query AS blocking_query, w.mode AS blocked_mode, w.relation AS blocked_relation
FROM t_locks w JOIN t_activity wa ON wa.cluster_id = w.cluster_id AND wa.snapshot_ts = w.snapshot_ts AND wa.pid = w.pid
JOIN t_locks o ON {_SAME_OBJECT}
JOIN t_activity oa ON oa.cluster_id = o.cluster_id AND oa.snapshot_ts = o.snapshot_ts AND oa.pid = o.pid
WHERE NOT w.granted {top(20, 'w.pid, o.pid, w.mode, o.mode', 'w.cluster_id, w.snapshot_ts')}""",
)
def _(t):
    return S.lock_waiters(t["t_locks"], t["t_activity"])


_OBJECT_ID = "w.locktype || '/' || " + " || '/' || ".join(f"coalesce(CAST(w.{c} AS VARCHAR), '-')" for c in S.LOCK_OBJECT)


@query(
    "d4_lock_wait_graph",
    ["t_locks", "t_activity"],
    f"""SELECT w.cluster_id, w.snapshot_ts, w.pid AS blocked_pid, wa.usename AS blocked_user, wa.query AS blocked_query,
  wa.query_start AS blocked_since, w.mode AS blocked_mode, w.granted, count(DISTINCT o.pid) AS blocking_sessions, count(*) AS blocking_locks,
  {_OBJECT_ID} AS object_id
FROM t_locks w JOIN t_activity wa ON wa.cluster_id = w.cluster_id AND wa.snapshot_ts = w.snapshot_ts AND wa.pid = w.pid
JOIN t_locks o ON {_SAME_OBJECT}
JOIN t_activity oa ON oa.cluster_id = o.cluster_id AND oa.snapshot_ts = o.snapshot_ts AND oa.pid = o.pid
GROUP BY ALL""",
)
def _(t):
    return S.lock_wait_graph(t["t_locks"], t["t_activity"])


_ACTIVE = f"""SELECT {K}, pid, datname AS database, usename AS username, client_addr, state, wait_event_type, wait_event,
  {age('snapshot_ts', 'query_start')} AS duration_seconds, {age('snapshot_ts', 'xact_start')} AS transaction_seconds, left(query, 500) AS query, backend_type
FROM t_activity WHERE state <> 'idle' AND {CLIENT} AND query NOT LIKE '%pg_catalog%' AND query NOT LIKE '%information_schema%'"""


def _active(t) -> dict:
    return S.active_queries(t["t_activity"], t["t_blocking_edges"])


@query("s7_active_detail", ["t_activity"], _ACTIVE)
def _(t):
    return _active(t)["active_queries"]


@query(
    "s7_active_all_options",
    ["t_activity"],
    f"""SELECT {K}, pid, datname AS database, usename AS username, client_addr, state, wait_event_type, wait_event,
  {age('snapshot_ts', 'query_start')} AS duration_seconds, {age('snapshot_ts', 'xact_start')} AS transaction_seconds, left(query, 500) AS query, backend_type
FROM t_activity WHERE datname = 'db1' AND epoch_us(snapshot_ts) - epoch_us(query_start) >= 36000000000""",
)
def _(t):
    return S.active_sessions(t["t_activity"], 36000, include_idle=True, include_system=True, database="db1")


@query(
    "s7_by_state", ["t_activity"], f"SELECT {K}, state, count(*) AS count FROM t_activity WHERE {CLIENT} GROUP BY ALL"
)
def _(t):
    return _active(t)["by_state"]


@query("s7_total_connections", ["t_activity"], f"SELECT {K}, count(*) AS total_connections FROM ({_ACTIVE}) GROUP BY {K}")
def _(t):
    return _active(t)["total_connections"]


@query(
    "s7_blocked_queries",
    ["t_activity", "t_blocking_edges"],
    f"""SELECT e.cluster_id, e.snapshot_ts, e.pid AS blocked_pid, a.query AS blocked_query, e.blocking_pid, b.query AS blocking_query, a.wait_event_type, a.wait_event
FROM t_blocking_edges e JOIN t_activity a ON a.cluster_id = e.cluster_id AND a.snapshot_ts = e.snapshot_ts AND a.pid = e.pid AND a.wait_event_type = 'Lock'
JOIN t_activity b ON b.cluster_id = e.cluster_id AND b.snapshot_ts = e.snapshot_ts AND b.pid = e.blocking_pid
{top(10, 'e.pid, e.blocking_pid', 'e.cluster_id, e.snapshot_ts')}""",
)
def _(t):
    return _active(t)["blocked_queries"]


@query(
    "s7_blocked_by_pid_lists",
    ["t_activity", "t_blocking_edges"],
    f"""SELECT DISTINCT e.cluster_id, e.snapshot_ts, e.pid AS blocked_pid, a.query AS blocked_query, e.blocking_pid, b.query AS blocking_query, a.wait_event_type, a.wait_event
FROM t_blocking_edges e JOIN t_activity a ON a.cluster_id = e.cluster_id AND a.snapshot_ts = e.snapshot_ts AND a.pid = e.pid AND a.wait_event_type = 'Lock'
JOIN t_activity b ON b.cluster_id = e.cluster_id AND b.snapshot_ts = e.snapshot_ts AND b.pid = e.blocking_pid""",
)
def _(t):
    """All pairs, without a limit, out of each session's list of blocking pids, which names some twice."""
    blockers = t["t_blocking_edges"].groupBy(*K.split(", "), "pid").agg(F.collect_list("blocking_pid").alias("pids"))
    sessions = t["t_activity"].join(blockers, [*K.split(", "), "pid"], "left")
    listed = sessions.withColumn("blocking_pids", F.concat("pids", "pids")).drop("pids")
    return S.active_queries(listed, blocked_limit=None)["blocked_queries"]


@query(
    "s7_findings",
    ["t_activity"],
    f"""SELECT * FROM (WITH a AS ({_ACTIVE}) {rule('active_queries', 'long_query', 'warning', 'pid', 'duration_seconds', "'pid ' || pid || ' runs for ' || duration_seconds || 's'", 'FROM a WHERE duration_seconds > 300')}
UNION ALL {rule('active_queries', 'idle_transaction', 'warning', 'pid', 'transaction_seconds', "'pid ' || pid || ' idle in transaction for ' || transaction_seconds || 's'", "FROM a WHERE state = 'idle in transaction' AND transaction_seconds > 60")})""",
)
def _(t):
    return _active(t)["findings"]


# --- replication --------------------------------------------------------------------------------


@query(
    "r1_replication_slots",
    ["t_slots"],
    f"SELECT {K}, slot_name, plugin, slot_type, database, active, {lsn('current_lsn')} - {lsn('restart_lsn')} AS restart_lsn_lag_bytes FROM t_slots",
)
def _(t):
    return R.replication_slots(t["t_slots"])


@query(
    "r2_replication_status",
    ["t_replication"],
    f"""SELECT {K}, application_name, client_addr, state, sync_state, sync_priority, {lsn('current_lsn')} - {lsn('sent_lsn')} AS sent_lag_bytes,
  {lsn('flush_lsn')} - {lsn('replay_lsn')} AS replay_lag_bytes, write_lag AS write_lag_time, flush_lag AS flush_lag_time, replay_lag AS replay_lag_time FROM t_replication""",
)
def _(t):
    return R.replication_status(t["t_replication"])


@query(
    "r3_logical_replication_status",
    ["t_subscriptions"],
    f"""SELECT {K}, subname, subid, (epoch_us(snapshot_ts) - epoch_us(last_msg_send_time)) / 1e6 AS send_lag_sec,
  (epoch_us(snapshot_ts) - epoch_us(last_msg_receipt_time)) / 1e6 AS receive_lag_sec FROM t_subscriptions WHERE subid IS NOT NULL""",
)
def _(t):
    return R.logical_replication_status(t["t_subscriptions"])


@query(
    "r4_wal_archiver_status",
    ["t_counters", "t_wal_files", "t_daily_databases"],
    f"""SELECT {K}, archived_count, failed_count, stats_reset, b AS wal_directory_bytes, {pretty('b')} AS wal_directory_size FROM (
  SELECT c.*, coalesce(f.b, CAST(round(d.b / 10.0::DOUBLE) AS BIGINT)) AS b FROM t_counters c
  LEFT JOIN (SELECT {K}, sum(size)::BIGINT AS b FROM t_wal_files GROUP BY ALL) f USING ({K})
  LEFT JOIN (SELECT {K}, sum(size_bytes)::BIGINT AS b FROM t_daily_databases GROUP BY ALL) d USING ({K}))""",
)
def _(t):
    return R.wal_archiver_status(t["t_counters"], t["t_wal_files"], t["t_daily_databases"])
