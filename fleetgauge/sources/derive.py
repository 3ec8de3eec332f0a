"""Telemetry derived from the test tables.

The test tables are no database telemetry, so each telemetry table is computed from them by one SQL
text that Spark SQL and the checking engine both run unchanged. ``{name}`` marks an input: a test
table, or another derived table. Counters are whole numbers, so no sum depends on row order, and
remainders keep sums inside BIGINT at any scale.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.session import apply_runtime_conf, shared_dir

BASE_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events")

_K_EVENT = """'c' || CAST(user_id % 5 AS STRING) AS cluster_id,
       CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS snapshot_ts"""
_K_ORDER = """'c' || CAST(o_custkey % 5 AS STRING) AS cluster_id,
       CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) + INTERVAL 1 YEAR AS snapshot_ts"""
_K_LINE = """'c' || CAST(l.l_suppkey % 5 AS STRING) AS cluster_id,
       CAST(date_trunc('year', l.l_shipdate) AS TIMESTAMP) + INTERVAL 1 YEAR AS snapshot_ts"""

# name, unit, value; per-cluster deviations follow in the text.
_SETTINGS = (
    ("max_connections", None, "80"),
    ("superuser_reserved_connections", None, "3"),
    ("shared_buffers", "8kB", "32768"),
    ("work_mem", "kB", "8192"),
    ("effective_cache_size", "8kB", "524288"),
    ("checkpoint_completion_target", None, "0.9"),
    ("autovacuum", None, "on"),
    ("autovacuum_max_workers", None, "3"),
    ("autovacuum_naptime", "s", "60"),
    ("autovacuum_vacuum_threshold", None, "50"),
    ("autovacuum_vacuum_scale_factor", None, "0.2"),
    ("autovacuum_freeze_max_age", None, "200000000"),
    ("autovacuum_multixact_freeze_max_age", None, "400000000"),
)
_SETTING_CHANGES = {
    "autovacuum": (3, "off"),
    "shared_buffers": (1, "8192"),
    "work_mem": (2, "1024"),
    "checkpoint_completion_target": (4, "0.5"),
}


# One snapshot of the settings per region key.
_SETTING_TIMES = ("1990-01-01 00:00:00", "1995-07-01 00:00:00", "1997-07-01 00:00:00", "2024-01-05 12:00:00", "2024-01-20 06:00:00")


def _settings_text() -> str:
    """Cluster x setting x snapshot out of nation x nation x region. Cluster c0 has no settings."""
    names = " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _, _) in enumerate(_SETTINGS))
    units = " ".join(f"WHEN {i} THEN '{unit}'" for i, (_, unit, _) in enumerate(_SETTINGS) if unit)
    times = " ".join(f"WHEN {i} THEN TIMESTAMP '{t}'" for i, t in enumerate(_SETTING_TIMES))
    position = {name: i for i, (name, _, _) in enumerate(_SETTINGS)}
    # Changed settings hold on one cluster from the second to the third snapshot; connections are raised for good.
    changed = " ".join(
        f"WHEN s.n_nationkey = {position[name]} AND c.n_nationkey = {nation - 1} AND r_regionkey IN (1, 2) THEN '{other}'"
        for name, (nation, other) in _SETTING_CHANGES.items()
    )
    grown = f"WHEN s.n_nationkey = {position['max_connections']} AND r_regionkey > 1 THEN '100'"
    plain = " ".join(f"WHEN s.n_nationkey = {i} THEN '{value}'" for i, (_, _, value) in enumerate(_SETTINGS))
    return f"""SELECT 'c' || CAST(c.n_nationkey + 1 AS STRING) AS cluster_id, CASE r_regionkey {times} END AS snapshot_ts,
       CASE s.n_nationkey {names} ELSE 'other_' || CAST(s.n_nationkey AS STRING) END AS name,
       CASE s.n_nationkey {units} END AS unit,
       CASE {changed} {grown} {plain} ELSE 'x' END AS setting
FROM {{nation}} c JOIN {{nation}} s ON c.n_nationkey % 1 = s.n_nationkey % 1 JOIN {{region}} r ON c.n_nationkey % 1 = r.r_regionkey % 1"""


TEXTS: dict[str, str] = {
    "t_activity": f"""
SELECT {_K_EVENT},
       event_id AS pid,
       'db' || CAST(user_id % 3 AS STRING) AS datname,
       'user' || CAST(user_id AS STRING) AS usename,
       CASE WHEN user_id % 4 = 0 THEN NULL ELSE '10.0.0.' || CAST(user_id AS STRING) END AS client_addr,
       CASE WHEN event_id % 11 = 0 THEN 'autovacuum worker' WHEN event_id % 97 = 0 THEN 'autovacuum launcher'
            ELSE 'client backend' END AS backend_type,
       CASE event_type WHEN 'view' THEN 'active' WHEN 'error' THEN 'active' WHEN 'click' THEN 'idle'
            WHEN 'purchase' THEN 'idle in transaction' END AS state,
       CAST(ts AS TIMESTAMP) - INTERVAL 2 HOUR AS backend_start,
       CAST(ts AS TIMESTAMP) AS query_start,
       CASE WHEN event_type IN ('purchase', 'error') THEN CAST(ts AS TIMESTAMP) - INTERVAL 1 HOUR END AS xact_start,
       CASE WHEN event_type = 'error' THEN 'Lock'
            WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'IO'
            WHEN event_type = 'view' AND event_id % 13 = 0 THEN 'BufferPin' END AS wait_event_type,
       CASE WHEN event_type = 'error' THEN 'relation'
            WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'DataFileRead'
            WHEN event_type = 'view' AND event_id % 13 = 0 THEN 'BufferPin' END AS wait_event,
       CASE WHEN event_id % 11 = 0 THEN 'autovacuum: VACUUM public.t' || CAST(user_id AS STRING)
            WHEN event_id % 17 = 0 THEN 'SELECT * FROM pg_catalog.pg_class'
            WHEN event_id % 19 = 0 THEN NULL
            ELSE 'SELECT ' || event_type || ' ' || props END AS query,
       CASE WHEN user_id % 5 = 4 THEN NULL ELSE user_id % 3 = 0 END AS ssl,
       CASE WHEN user_id % 3 = 0 THEN 'TLSv1.3' END AS ssl_version,
       CASE WHEN user_id % 3 = 0 THEN 'TLS_AES_256_GCM_SHA384' END AS ssl_cipher,
       CASE WHEN user_id % 5 = 4 THEN NULL ELSE user_id % 14 = 0 END AS gss_authenticated,
       CASE WHEN user_id % 5 = 4 THEN NULL ELSE user_id % 7 = 0 END AS gss_encrypted
FROM {{events}}
""",
    "t_blocking_edges": """
SELECT a.cluster_id, a.snapshot_ts, a.pid, b.blocking_pid
FROM {t_activity} a JOIN (
  SELECT cluster_id, snapshot_ts, usename, min(pid) AS blocking_pid FROM {t_activity} GROUP BY cluster_id, snapshot_ts, usename) b
  ON a.cluster_id = b.cluster_id AND a.snapshot_ts = b.snapshot_ts AND a.usename = b.usename
WHERE a.wait_event_type = 'Lock' AND a.pid <> b.blocking_pid
""",
    "t_locks": f"""
SELECT {_K_EVENT},
       event_id AS pid,
       CASE WHEN event_id % 3 = 0 THEN 'transactionid' ELSE 'relation' END AS locktype,
       CAST(user_id % 3 AS BIGINT) AS database,
       CASE WHEN event_id % 3 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 END AS relation,
       CASE WHEN event_id % 3 = 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS transactionid,
       CAST(NULL AS BIGINT) AS page, CAST(NULL AS BIGINT) AS tuple, CAST(NULL AS STRING) AS virtualxid,
       CASE event_type WHEN 'view' THEN 'AccessShareLock' WHEN 'error' THEN 'AccessExclusiveLock'
            ELSE 'RowExclusiveLock' END AS mode,
       event_type <> 'error' AS granted
FROM {{events}}
""",
    "t_tables": f"""
SELECT {_K_LINE},
       CASE WHEN p.p_size % 11 = 0 THEN 'pg_catalog' WHEN p.p_size % 7 = 0 THEN 'audit' ELSE 'public' END AS schemaname,
       replace(p.p_brand, '#', '_') || '_' || lower(p.p_type) AS relname,
       'r' AS relkind,
       CAST(count(*) FILTER (WHERE l_returnflag = 'N') * 100 AS BIGINT) AS n_tup_ins,
       CAST(count(*) FILTER (WHERE l_returnflag = 'A') * 100 AS BIGINT) AS n_tup_upd,
       CAST(count(*) FILTER (WHERE l_returnflag = 'R') * 100 AS BIGINT) AS n_tup_del,
       CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) * 50 AS BIGINT) AS n_live_tup,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) * 10 AS BIGINT) AS n_dead_tup,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) * 12 AS BIGINT) AS n_mod_since_analyze,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) * 20 AS BIGINT) AS seq_scan,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) * 20 AS BIGINT) AS idx_scan,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) * 400 AS BIGINT) AS seq_tup_read,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) END) * 40 AS BIGINT) AS idx_tup_fetch,
       CAST(sum(CAST(l_quantity AS BIGINT)) * 30 AS BIGINT) AS heap_blks_hit,
       CAST(sum(l_linenumber) * 25 AS BIGINT) AS heap_blks_read,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) END) * 20 AS BIGINT) AS idx_blks_hit,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) * 5 AS BIGINT) AS idx_blks_read,
       CAST(sum(CASE WHEN l_linenumber = 6 THEN l_linenumber END) AS BIGINT) AS toast_blks_read,
       CAST(sum(CASE WHEN l_linenumber = 6 THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS toast_blks_hit,
       CAST(max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS TIMESTAMP) AS last_vacuum,
       CAST(max(CASE WHEN l_returnflag = 'A' AND l_linenumber > 2 THEN l_shipdate END) AS TIMESTAMP) AS last_autovacuum,
       CAST(max(CASE WHEN l_returnflag = 'N' AND l_linenumber > 3 THEN l_shipdate END) AS TIMESTAMP) AS last_analyze,
       CAST(max(CASE WHEN l_returnflag = 'A' AND l_linenumber > 5 THEN l_shipdate END) AS TIMESTAMP) AS last_autoanalyze,
       CAST(count(*) FILTER (WHERE l_linenumber = 1) AS BIGINT) AS vacuum_count,
       CAST(count(*) FILTER (WHERE l_linenumber = 2) AS BIGINT) AS autovacuum_count,
       CAST(count(*) FILTER (WHERE l_linenumber = 3) AS BIGINT) AS analyze_count,
       CAST(count(*) FILTER (WHERE l_linenumber = 4) AS BIGINT) AS autoanalyze_count,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS relpages,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 28 AS BIGINT) AS table_size_bytes,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 12 AS BIGINT) AS indexes_size_bytes,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 40 AS BIGINT) AS total_size_bytes,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 3 % 2147483647 AS BIGINT) AS xid_age,
       CAST(sum(CAST(l_partkey % 9973 AS BIGINT)) * 90000 % 900000000 AS BIGINT) AS mxid_age,
       CAST(sum(l_linenumber) % 9 AS BIGINT) AS relminmxid
FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2, 3, 4
""",
    "t_toast": """
SELECT cluster_id, snapshot_ts, schemaname, relname,
       CASE WHEN toast_blks_read IS NOT NULL THEN 'pg_toast_' || schemaname || '_' || relname END AS toast_relname,
       toast_blks_read * 8192 AS toast_size_bytes
FROM {t_tables}
""",
    "t_databases": """
SELECT 'c' || CAST(c.c_nationkey % 5 AS STRING) AS cluster_id,
       CAST(date_trunc('year', o.o_orderdate) AS TIMESTAMP) + INTERVAL 1 YEAR AS snapshot_ts,
       CASE c.c_nationkey WHEN 0 THEN 'template0' WHEN 1 THEN 'template1'
            ELSE 'db' || CAST(c.c_nationkey AS STRING) END AS datname,
       c.c_nationkey < 2 AS datistemplate,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS xact_commit,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS xact_rollback,
       CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS blks_hit,
       CAST(sum(o_orderkey % 9000) AS BIGINT) AS blks_read,
       CAST(sum(o_orderkey % 700) AS BIGINT) AS blk_read_time,
       CAST(sum(o_orderkey % 300) AS BIGINT) AS blk_write_time,
       CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0) AS BIGINT) AS temp_files,
       CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(round(o_totalprice) AS BIGINT) ELSE 0 END) * 1000 AS BIGINT) AS temp_bytes,
       CAST(count(*) FILTER (WHERE o_orderkey % 50 = 0) AS BIGINT) AS deadlocks,
       CAST(count(*) FILTER (WHERE o_orderkey % 90 = 1) AS BIGINT) AS confl_tablespace,
       CAST(count(*) FILTER (WHERE o_orderkey % 90 = 2) AS BIGINT) AS confl_lock,
       CAST(count(*) FILTER (WHERE o_orderkey % 90 = 3) AS BIGINT) AS confl_snapshot,
       CAST(count(*) FILTER (WHERE o_orderkey % 90 = 4) AS BIGINT) AS confl_bufferpin,
       CAST(count(*) FILTER (WHERE o_orderkey % 90 = 5) AS BIGINT) AS confl_deadlock,
       CAST(count(*) FILTER (WHERE o_orderkey % 20 = 6) AS BIGINT) AS confl_active_logicalslot,
       CAST(sum(o_orderkey % 9973) * 99700 % 2147483647 AS BIGINT) AS xid_age,
       CAST(sum(o_custkey % 997) * 819100 % 2147483700 AS BIGINT) AS mxid_age,
       CAST(c.c_nationkey % 6 AS BIGINT) AS datminmxid,
       c.c_nationkey % 8 <> 7 AS datallowconn,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) * 100 AS BIGINT) AS size_bytes
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
GROUP BY c.c_nationkey, 1, 2, 3, 4
""",
    "t_daily_databases": f"""
SELECT {_K_EVENT}, 'db' || CAST(user_id % 3 AS STRING) AS datname,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) * 1000 AS BIGINT) AS size_bytes
FROM {{events}} GROUP BY 1, 2, 3
""",
    "t_statements": f"""
SELECT {_K_ORDER},
       o_custkey AS queryid,
       CASE WHEN o_custkey % 23 = 0 THEN 'SELECT * FROM pg_catalog.pg_class' WHEN o_custkey % 29 = 0 THEN 'SELECT $1'
            WHEN o_custkey % 31 = 0 THEN 'UPDATE t1 SET a = 1'
            ELSE 'SELECT * FROM t' || CAST(o_custkey % 40 AS STRING) END AS query,
       CAST(count(*) * 3 AS BIGINT) AS calls,
       CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total_exec_us,
       CAST(min(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS min_exec_us,
       CAST(max(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS max_exec_us,
       CAST(floor((max(CAST(round(o_totalprice) AS BIGINT)) - min(CAST(round(o_totalprice) AS BIGINT))) / 4) AS BIGINT) AS stddev_exec_us,
       CAST(sum(o_orderkey % 1000) AS BIGINT) AS rows_returned,
       CAST(sum(o_orderkey % 700) AS BIGINT) AS shared_blks_hit,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 300 ELSE 0 END) AS BIGINT) AS shared_blks_read,
       CAST(sum(o_orderkey % 11) AS BIGINT) AS temp_blks_read, CAST(sum(o_orderkey % 13) AS BIGINT) AS temp_blks_written
FROM {{orders}} GROUP BY o_custkey, 2
""",
    "t_index_columns": f"""
SELECT {_K_ORDER}, 'public' AS schema_name,
       't' || CAST(o.o_custkey AS STRING) AS table_name,
       'ix_' || CAST(l.l_orderkey AS STRING) AS index_name,
       l.l_linenumber AS pos,
       CASE l.l_linenumber % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'id' ELSE 'created_at' END
         || CAST(l.l_linenumber AS STRING) AS column_name
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM {{lineitem}}) l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
""",
    "t_index_facts": f"""
SELECT {_K_ORDER}, 'public' AS schema_name, 't' || CAST(o_custkey AS STRING) AS table_name,
       'ix_' || CAST(o_orderkey AS STRING) AS index_name,
       CASE o_orderpriority WHEN '5-LOW' THEN 'gin' ELSE 'btree' END AS access_method,
       o_orderkey % 2 = 0 AS is_unique, o_orderstatus = 'P' AS is_primary, o_orderkey % 37 <> 0 AS is_valid,
       CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes,
       'CREATE INDEX ix_' || CAST(o_orderkey AS STRING) AS definition
FROM {{orders}}
""",
    "t_index_counters": f"""
SELECT {_K_ORDER}, 'public' AS schemaname, 't' || CAST(o_custkey AS STRING) AS relname,
       'ix_' || CAST(o_orderkey AS STRING) AS index_name,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 50 END AS idx_scan, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 900 END AS idx_tup_read,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 800 END AS idx_tup_fetch
FROM {{orders}}
""",
    "t_heap_samples": """
SELECT cluster_id, snapshot_ts, schemaname, relname, table_len, tuple_len, tuple_count, tuple_percent,
       dead_tuple_percent, dead_tuple_count, CAST(floor(table_len * dead_tuple_percent / 100) AS BIGINT) AS dead_tuple_len,
       free_percent, CAST(floor(table_len * free_percent / 100) AS BIGINT) AS free_space,
       CAST(tuple_percent AS BIGINT) + 1 AS approx_tuple_percent, tuple_len AS approx_tuple_len, tuple_count AS approx_tuple_count,
       CAST(free_percent AS BIGINT) + 1 AS approx_free_percent,
       CAST(floor(table_len * (free_percent + 1) / 100) AS BIGINT) AS approx_free_space,
       tuple_count % 101 AS scanned_percent
FROM (
  SELECT cluster_id, snapshot_ts, schemaname, relname,
         total_size_bytes AS table_len,
         CAST(floor(total_size_bytes * (30 + n_live_tup % 65) / 100) AS BIGINT) AS tuple_len,
         n_live_tup AS tuple_count,
         CAST(30 + n_live_tup % 65 AS BIGINT) AS tuple_percent,
         CAST(floor(n_dead_tup / 10) AS BIGINT) % 40 AS dead_tuple_percent,
         n_dead_tup AS dead_tuple_count,
         CAST(floor(seq_scan / 20) AS BIGINT) % 38 AS free_percent
  FROM {t_tables}
  UNION ALL
  SELECT t.cluster_id, t.snapshot_ts, 'pg_toast' AS schemaname, t.toast_relname AS relname, t.toast_size_bytes AS table_len,
         t.toast_size_bytes AS tuple_len, t.toast_size_bytes AS tuple_count, t.toast_size_bytes % 90 AS tuple_percent,
         t.toast_size_bytes % 40 AS dead_tuple_percent, t.toast_size_bytes AS dead_tuple_count, t.toast_size_bytes % 38 AS free_percent
  FROM {t_toast} t WHERE t.toast_relname IS NOT NULL) s
""",
    "t_replication": f"""
SELECT cluster_id, snapshot_ts, application_name, client_addr, state, sync_state, sync_priority,
       write_lag, flush_lag, replay_lag,
       base || hex(newest * 400000) AS current_lsn, base || hex(CAST(floor((newest + oldest) / 2) AS BIGINT) * 400000) AS sent_lsn,
       base || hex(newest * 400000 - 400) AS flush_lsn, base || hex(oldest * 400000) AS replay_lsn
FROM (SELECT {_K_EVENT}, 'r' || CAST(user_id AS STRING) AS application_name,
       CASE WHEN user_id % 4 = 0 THEN NULL ELSE '10.0.0.' || CAST(user_id AS STRING) END AS client_addr,
       'streaming' AS state, CASE WHEN user_id % 2 = 0 THEN 'sync' ELSE 'async' END AS sync_state,
       CAST(user_id % 4 AS BIGINT) AS sync_priority,
       CASE WHEN user_id % 3 = 0 THEN '00:00:01' END AS write_lag, CASE WHEN user_id % 3 = 0 THEN '00:00:02' END AS flush_lag,
       CASE WHEN user_id % 3 = 0 THEN '00:00:03' END AS replay_lag,
       upper(hex(max(event_id) % 16 + 1)) || '/' AS base, max(event_id) AS newest, min(event_id) AS oldest
  FROM {{events}} GROUP BY user_id, 1, 2) r
""",
    "t_slots": f"""
SELECT {_K_EVENT}, 'slot_' || CAST(user_id AS STRING) AS slot_name,
       CASE WHEN user_id % 2 = 0 THEN 'pgoutput' END AS plugin,
       CASE WHEN user_id % 2 = 0 THEN 'logical' ELSE 'physical' END AS slot_type,
       CASE WHEN user_id % 2 = 0 THEN 'db' || CAST(user_id % 3 AS STRING) END AS database, user_id % 5 <> 0 AS active,
       upper(hex(max(event_id) % 16 + 1)) || '/' || hex(max(event_id) * 400000) AS current_lsn,
       upper(hex(max(event_id) % 16 + 1)) || '/' || hex(min(event_id) * 300000) AS restart_lsn
FROM {{events}} GROUP BY user_id, 1, 2
""",
    "t_plan_nodes": """
SELECT l_orderkey AS plan_id, CAST(l_linenumber AS STRING) AS node_id,
       CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber - 1 AS STRING) END AS parent_id,
       CASE l_linenumber WHEN 1 THEN 'Hash Join' WHEN 2 THEN 'Sort' WHEN 3 THEN 'Nested Loop' WHEN 4 THEN 'Index Scan' ELSE 'Seq Scan' END AS node_type,
       't' || CAST(max(l_partkey) % 50 AS STRING) AS relation_name,
       CASE WHEN l_linenumber = 4 THEN 'ix_' || CAST(max(l_partkey) % 50 AS STRING) END AS index_name,
       CAST(max(l_partkey) * 20 AS DOUBLE) AS actual_rows,
       CAST(max(CAST(l_quantity AS BIGINT)) * 200 AS DOUBLE) AS plan_rows,
       CAST(max(l_suppkey) % 4 AS DOUBLE) AS hash_batches,
       CASE WHEN max(l_suppkey) % 3 = 0 THEN 'external merge' ELSE 'quicksort' END AS sort_method,
       CAST(max(l_partkey) * 2 AS DOUBLE) AS actual_loops,
       CASE WHEN max(l_suppkey) % 2 = 0 THEN '(status = 1)' END AS filter_cond,
       CAST(min(l_partkey) AS DOUBLE) AS startup_cost,
       CAST(max(l_partkey) * 20 AS DOUBLE) AS total_cost
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
""",
    "t_plan_nodes_after": """
SELECT plan_id, node_id, parent_id, CASE node_type WHEN 'Seq Scan' THEN 'Bitmap Index Scan' ELSE node_type END AS node_type,
       CASE WHEN node_type = 'Seq Scan' THEN '<1>ix_' || relation_name ELSE index_name END AS index_name,
       startup_cost, total_cost - startup_cost AS total_cost
FROM {t_plan_nodes}
""",
    "t_created_indexes": """
SELECT plan_id, 'ix_t' || CAST(part AS STRING) AS index_name
FROM (SELECT DISTINCT l_orderkey AS plan_id, l_partkey % 50 AS part FROM {lineitem}) u
""",
    "t_plan_json": """
SELECT o_orderkey AS plan_id,
       CASE WHEN o_orderkey % 2 = 0 THEN '[' ELSE '' END
       || '{"Plan": {"Node Type": "Hash Join", "Plan Rows": ' || CAST(o_custkey AS STRING) || ', "Actual Rows": ' || CAST(o_orderkey AS STRING)
       || ', "Startup Cost": 1.5, "Total Cost": ' || CAST(o_orderkey * 2 AS STRING) || '.5, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "t'
       || CAST(o_custkey % 40 AS STRING) || '", "Plan Rows": ' || CAST(o_orderkey * 3 AS STRING) || ', "Filter": "(a = ''x'')"}'
       || CASE WHEN o_orderstatus = 'O' THEN '' ELSE ', {"Node Type": "Hash", "Hash Batches": ' || CAST(o_custkey % 4 AS STRING)
          || ', "Plans": [{"Node Type": "Index Scan", "Index Name": "ix_' || CAST(o_custkey AS STRING) || '", "Total Cost": 8.25}]}' END
       || ']}, "Planning Time": 0.5, "Execution Time": ' || CAST(o_custkey AS STRING) || '.25}'
       || CASE WHEN o_orderkey % 2 = 0 THEN ']' ELSE '' END AS plan
FROM {orders}
""",
    "t_settings": _settings_text(),
    "t_prepared_xacts": f"""
SELECT {_K_EVENT}, 'gid' || CAST(event_id AS STRING) AS gid, 'user' || CAST(user_id AS STRING) AS owner,
       'db' || CAST(user_id % 3 AS STRING) AS database, CAST(ts AS TIMESTAMP) AS prepared, event_id AS transaction
FROM {{events}}
""",
    "t_sequences": """
SELECT 'c' || CAST(p_partkey % 5 AS STRING) AS cluster_id, TIMESTAMP '2024-01-01 00:00:00' AS snapshot_ts, 'public' AS schemaname,
       'seq_' || CAST(p_partkey AS STRING) AS sequence_name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey * 77 % 32767 END AS last_val,
       CAST(32767 AS BIGINT) AS max_val, p_size % 5 = 0 AS seqcycle
FROM {part}
""",
    "t_indexes": f"""
SELECT {_K_LINE}, 'public' AS schemaname,
       replace(p.p_brand, '#', '_') || '_' || lower(p.p_type) AS relname,
       replace(p.p_brand, '#', '_') || '_' || lower(p.p_type) || CASE l_linenumber WHEN 1 THEN '_pkey' ELSE '_ix' || CAST(l_linenumber AS STRING) END AS index_name,
       CASE l_linenumber WHEN 6 THEN 'gin' WHEN 7 THEN 'hash' ELSE 'btree' END AS access_method,
       l_linenumber = 1 AS is_primary, max(l_partkey) % 37 <> 0 AS is_valid,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS idx_scan,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS idx_tup_read, CAST(sum(l_linenumber) AS BIGINT) AS idx_tup_fetch,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS relpages,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 10 AS BIGINT) AS size_bytes,
       'CREATE INDEX ON ' || replace(p.p_brand, '#', '_') || '_' || lower(p.p_type) AS definition,
       CAST(sum(CAST(l_quantity AS BIGINT)) * 100 AS BIGINT) AS idx_blks_hit, CAST(sum(l_partkey % 9973) AS BIGINT) AS idx_blks_read
FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 4, 5, l_linenumber, p.p_brand, p.p_type
""",
    "t_index_samples": """
SELECT cluster_id, snapshot_ts, schemaname, relname, index_name, access_method, size_bytes,
       CASE WHEN size_bytes % 50 = 0 THEN NULL ELSE 35 + CAST(floor(size_bytes / 10) AS BIGINT) % 60 END AS avg_leaf_density,
       100 + idx_blks_read % 100 AS leaf_pages, idx_blks_read % 20 AS empty_pages, idx_blks_read % 31 AS deleted_pages,
       idx_blks_read % 45 AS leaf_fragmentation, idx_blks_read % 40 AS pending_pages, idx_blks_read % 1500 AS pending_tuples,
       idx_blks_read % 64 AS bucket_pages, idx_blks_read % 9 AS overflow_pages, idx_blks_read % 3 AS bitmap_pages,
       idx_blks_read % 8 AS unused_pages, idx_blks_read % 5000 AS live_items, idx_blks_read % 150 AS dead_items,
       idx_blks_read % 77 AS hash_free_percent
FROM {t_indexes}
""",
    "t_io_contexts": f"""
SELECT {_K_EVENT},
       CASE WHEN event_type = 'signup' THEN NULL ELSE event_type END AS backend_type,
       CASE WHEN event_id % 2 = 0 THEN 'relation' ELSE 'temp relation' END AS object, CASE WHEN event_id % 3 = 0 THEN 'vacuum' ELSE 'normal' END AS context,
       CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS reads,
       CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) * 8192 AS BIGINT) AS read_bytes,
       CAST(sum(user_id) AS BIGINT) AS writes, CAST(sum(user_id) * 8192 AS BIGINT) AS write_bytes,
       CAST(count(*) AS BIGINT) AS extends, CAST(count(*) * 8192 AS BIGINT) AS extend_bytes, CAST(count(*) AS BIGINT) AS hits,
       CAST(sum(event_id % 5) AS BIGINT) AS evictions, CAST(sum(event_id % 6) AS BIGINT) AS reuses,
       CAST(sum(event_id % 7) AS BIGINT) AS fsyncs, CAST(sum(event_id % 8) AS BIGINT) AS fsync_time
FROM {{events}} GROUP BY 1, 2, 3, 4, 5
""",
    "t_counters": f"""
SELECT {_K_EVENT},
       CAST(min(ts) AS TIMESTAMP) - INTERVAL 12 HOUR AS stats_reset,
       CAST(count(*) FILTER (WHERE event_type <> 'error') * 2 AS BIGINT) AS checkpoints_timed,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS checkpoints_req,
       CAST(sum(user_id) AS BIGINT) AS buffers_checkpoint, CAST(sum(user_id % 40) AS BIGINT) AS buffers_clean, CAST(sum(user_id % 60) AS BIGINT) AS buffers_backend,
       CAST(sum(user_id % 7) AS BIGINT) AS maxwritten_clean, CAST(sum(event_id % 100) AS BIGINT) AS buffers_alloc,
       CAST(sum(user_id * 2) AS BIGINT) AS write_time_ms, CAST(sum(event_id % 30) AS BIGINT) AS sync_time_ms,
       CAST(sum(user_id % 3) AS BIGINT) AS slru_written,
       CAST(sum(event_id % 9973) AS BIGINT) AS wal_records, CAST(sum(event_id % 9) AS BIGINT) AS wal_fpi,
       CAST(sum(event_id % 9973) * 100 AS BIGINT) AS wal_bytes, CAST(sum(event_id % 4) AS BIGINT) AS wal_buffers_full,
       CAST(count(*) AS BIGINT) AS archived_count, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed_count
FROM {{events}} GROUP BY 1, 2
""",
    "t_slru": f"""
SELECT {_K_EVENT}, 'obj' || CAST(user_id AS STRING) AS name,
       CAST(count(*) FILTER (WHERE event_type = 'signup') AS BIGINT) AS blks_zeroed, CAST(count(*) AS BIGINT) AS blks_hit,
       CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS blks_read, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS blks_written,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS blks_exists, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS flushes,
       CAST(count(*) FILTER (WHERE event_id % 9 = 0) AS BIGINT) AS truncates
FROM {{events}} GROUP BY 1, 2, 3
""",
    "t_functions": f"""
SELECT {_K_EVENT}, user_id AS funcid, 'public' AS schemaname, 'fn' || CAST(user_id AS STRING) AS funcname,
       CAST(count(*) FILTER (WHERE event_type <> 'signup') AS BIGINT) AS calls,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_time_us, CAST(sum(CAST(round(value * 70) AS BIGINT)) AS BIGINT) AS self_time_us
FROM {{events}} GROUP BY 1, 2, 3
""",
    "t_progress": """
SELECT cluster_id, snapshot_ts, pid, datname, CASE pid % 4 WHEN 0 THEN 'analyze' WHEN 1 THEN 'create_index' WHEN 2 THEN 'cluster' ELSE 'vacuum' END AS operation,
       CASE WHEN pid % 9 = 0 THEN 'pg_catalog' ELSE 'public' END AS schemaname,
       CASE WHEN pid % 13 = 0 THEN NULL WHEN pid % 10 = 0 THEN 'pg_toast_' || CAST(pid % 60 AS STRING) WHEN pid % 10 = 7 THEN 'pg_toast_' || CAST(pid % 60 AS STRING)
            ELSE 't' || CAST(pid % 60 AS STRING) END AS relname,
       CASE WHEN pid % 4 = 1 THEN 'ix' || CAST(pid % 60 AS STRING) END AS index_name, 'scanning' AS phase,
       (pid % 7) * 100 AS blocks_total, (pid % 7) * (pid % 100) AS blocks_scanned, (pid % 7) * (pid % 50) AS blocks_done,
       CASE pid % 8 WHEN 1 THEN 'CREATE INDEX' WHEN 5 THEN 'REINDEX' WHEN 2 THEN 'CLUSTER' WHEN 6 THEN 'VACUUM FULL' END AS command,
       pid % 1000 AS tuples_total, pid % 500 AS tuples_done, pid % 3 AS partitions_total, pid % 2 AS partitions_done,
       pid % 5 AS child_tables_total, pid % 4 AS child_tables_done, CAST(pid % 80 AS DOUBLE) / 8 AS delay_time,
       pid % 900 AS heap_tuples_scanned, pid % 800 AS heap_tuples_written, CASE WHEN pid % 3 = 0 THEN pid END AS cluster_index_relid,
       pid % 6 AS index_vacuum_count, pid % 700 AS max_dead_tuples, pid % 300 AS num_dead_tuples
FROM {t_activity}
""",
    "t_subscriptions": """
SELECT cluster_id, snapshot_ts, 'sub_' || usename AS subname, CASE WHEN max(pid) % 9 = 0 THEN NULL ELSE max(pid) END AS subid,
       max(query_start) AS last_msg_send_time, min(query_start) AS last_msg_receipt_time
FROM {t_activity} GROUP BY cluster_id, snapshot_ts, usename
""",
    "t_wal_files": """
SELECT cluster_id, snapshot_ts, pid AS file_no, CASE WHEN cluster_id <> 'c4' THEN CAST(16777216 AS BIGINT) END AS size FROM {t_activity}
""",
    "t_column_usage": """
SELECT DISTINCT 'c' || CAST(custkey % 5 AS STRING) AS cluster_id, custkey AS queryid,
       CASE WHEN line = 7 THEN NULL WHEN custkey % 2 = 0 THEN 't' || CAST(custkey % 20 AS STRING)
            ELSE 't' || CAST(part AS STRING) END AS table_name,
       'c' || CAST(line AS STRING) AS column_name
FROM (SELECT DISTINCT o_custkey AS custkey, l_partkey % 20 AS part, l_linenumber AS line
      FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey) u
""",
    "t_query_tables": """
SELECT DISTINCT 'c' || CAST(custkey % 5 AS STRING) AS cluster_id, custkey AS queryid,
       CASE WHEN custkey % 2 = 0 THEN 't' || CAST(custkey % 20 AS STRING) ELSE 't' || CAST(part AS STRING) END AS table_name
FROM (SELECT DISTINCT o_custkey AS custkey, l_partkey % 20 AS part
      FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey) u
""",
    "t_column_widths": """
SELECT cluster_id, table_name, column_name,
       CASE WHEN column_name = 'c6' THEN NULL ELSE CAST(substring(column_name, 2) AS BIGINT) * 5 + CAST(substring(table_name, 2) AS BIGINT) % 7 END AS avg_width
FROM (SELECT DISTINCT cluster_id, table_name, column_name FROM {t_column_usage} WHERE table_name IS NOT NULL) u
""",
    "t_table_rows": """
SELECT 'c' || CAST(l_suppkey % 5 AS STRING) AS cluster_id, 't' || CAST(l_partkey % 20 AS STRING) AS table_name, CAST(count(*) * 1000 AS BIGINT) AS row_count
FROM {lineitem} GROUP BY 1, 2
""",
    "t_what_if": """
SELECT 'c' || CAST(o_custkey % 5 AS STRING) AS cluster_id, o_custkey AS queryid, 't' || CAST(l_partkey % 20 AS STRING) AS table_name,
       CASE WHEN l_linenumber = 7 THEN 'c1,c2,c3' ELSE 'c' || CAST(l_linenumber AS STRING) END AS candidate_columns,
       CAST(max(l_partkey) * 10 + 100 AS BIGINT) AS cost_before, CAST(min(l_partkey) * 10 + 1 AS BIGINT) AS cost_after, max(l_suppkey) % 3 <> 0 AS would_use
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3, 4
""",
    "t_page_free_space": """
SELECT 'c' || CAST(l_suppkey % 5 AS STRING) AS cluster_id, 't' || CAST(l_partkey % 50 AS STRING) AS relname, l_orderkey AS blkno,
       l_partkey * 37 % 8192 AS avail
FROM {lineitem}
""",
}

_INPUT = re.compile(r"\{(\w+)\}")


def inputs_of(name: str) -> list[str]:
    """The tables a derived table reads directly."""
    return list(dict.fromkeys(_INPUT.findall(TEXTS[name])))


def needed(names: list[str]) -> list[str]:
    """The derived tables behind ``names``, inputs first."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in TEXTS and name not in out:
            for part in inputs_of(name):
                visit(part)
            out.append(name)

    for name in names:
        visit(name)
    return out


def plain_sql(name: str) -> str:
    """The text of a derived table over tables of the same names."""
    return _INPUT.sub(lambda m: m.group(1), TEXTS[name]).strip()


def _spark_sql(name: str) -> str:
    """The text for ``spark.sql(text, **frames)``, where other braces have to be doubled."""
    doubled = TEXTS[name].replace("{", "{{").replace("}", "}}")
    return re.sub(r"\{\{(\w+)\}\}", r"{\1}", doubled)


def with_derived(names: list[str], body: str) -> str:
    """``body`` with the derived tables it names in front of it."""
    ctes = ",\n".join(f"{name} AS (\n{plain_sql(name)}\n)" for name in needed(names))
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()


def _without_zone(df: DataFrame) -> DataFrame:
    """Instants as wall-clock timestamps, the type of the test tables."""
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}) if stamps else df


class Telemetry(Mapping):
    """Test tables and derived telemetry tables of one folder, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = apply_runtime_conf(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in TEXTS:
                parts = {p: self[p] for p in inputs_of(name)}
                self._built[name] = _without_zone(self.spark.sql(_spark_sql(name), **parts))
            else:
                self._built[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._built[name]

    def stored(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """A derived table (or ``rows``) written to the shared folder and read back, for reports that read it several times.

        Spark would aggregate the test tables anew for each reader, because each needs other columns.
        """
        key = f"stored {name}"
        if key not in self._built:
            rows = self[name] if rows is None else rows
            path = f"{shared_dir(self.spark)}/fleetgauge-{name}-{uuid.uuid4().hex}"
            rows.write.parquet(path)
            self._built[key] = self.spark.read.schema(rows.schema).parquet(path)
        return self._built[key]

    def __iter__(self) -> Iterator[str]:
        return iter([*BASE_TABLES, *TEXTS])

    def __len__(self) -> int:
        return len(BASE_TABLES) + len(TEXTS)
