"""Performance, I/O, statements and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import performance as P
from fleetgauge.queries.registry import CHECKS, K, SYSTEM, age, fixed, hit, pct, pct0, pretty, query, rule, top, trunc


@query(
    "p1_cache_hit_rate",
    ["t_databases"],
    f"SELECT {K}, datname, blks_read, blks_hit, {pct('blks_hit', 'blks_hit + blks_read')} AS hit_rate_percentage FROM t_databases WHERE blks_hit + blks_read > 0",
)
def _(t):
    return P.cache_hit_rate(t["t_databases"])


def _grown(table: str, ids: str, counters: list[str]) -> str:
    """Counter growth by a plain lag over the whole series."""
    cols = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL WHEN _{c} IS NULL THEN {c} WHEN {c} < _{c} THEN {c} ELSE {c} - _{c} END AS {c}" for c in counters
    )
    lags = ", ".join(f"lag({c}) OVER w AS _{c}" for c in counters)
    return (
        f"(SELECT * EXCLUDE (_n, {', '.join(f'_{c}' for c in counters)}) REPLACE ({cols}) FROM (SELECT *, row_number() OVER w AS _n, {lags} FROM {table} "
        f"WINDOW w AS (PARTITION BY {ids} ORDER BY snapshot_ts)) WHERE _n > 1)"
    )


@query(
    "p1_cache_hit_rate_interval",
    ["t_databases"],
    f"SELECT {K}, datname, blks_read, blks_hit, {pct('blks_hit', 'blks_hit + blks_read')} AS hit_rate_percentage "
    f"FROM {_grown('t_databases', 'cluster_id, datname', ['blks_read', 'blks_hit'])} WHERE blks_hit + blks_read > 0",
)
def _(t):
    return P.cache_hit_rate(t["t_databases"], mode="interval")


@query(
    "p2_rollback_rate",
    ["t_databases"],
    f"SELECT {K}, datname, xact_commit, xact_rollback, {trunc('xact_rollback', 'xact_commit + xact_rollback')} AS rollback_percentage FROM t_databases",
)
def _(t):
    return P.rollback_rate(t["t_databases"])


@query(
    "p3_table_hotspots",
    ["t_tables"],
    f"""SELECT {K}, schemaname, relname, n_tup_ins + n_tup_upd + n_tup_del AS total_dml, seq_scan + idx_scan AS total_scans, n_dead_tup FROM t_tables
{top(5, 'n_tup_ins + n_tup_upd + n_tup_del DESC NULLS FIRST, seq_scan + idx_scan DESC NULLS FIRST, schemaname, relname')}""",
)
def _(t):
    return P.table_hotspots(t["t_tables"])


@query("p4_bgwriter_stats", ["t_counters"], f"SELECT {K}, buffers_clean, maxwritten_clean, buffers_alloc FROM t_counters")
def _(t):
    return P.bgwriter_stats(t["t_counters"])


@query(
    "p4_bgwriter_interval",
    ["t_counters"],
    f"SELECT {K}, buffers_clean, maxwritten_clean, buffers_alloc FROM {_grown('t_counters', 'cluster_id', ['buffers_clean', 'maxwritten_clean', 'buffers_alloc'])}",
)
def _(t):
    return P.bgwriter_stats(t["t_counters"], mode="interval")


@query(
    "p5_temp_file_usage",
    ["t_databases"],
    f"""SELECT {K}, datname, temp_files, temp_bytes, {pretty('temp_bytes')} AS temp_bytes_pretty,
  CAST((200 * temp_bytes::HUGEINT + 1073741824) // 2147483648 AS DOUBLE) / 100 AS temp_bytes_gb, temp_files::DOUBLE / total AS temp_files_ratio
FROM (SELECT *, sum(temp_files) OVER (PARTITION BY {K}) AS total FROM t_databases WHERE temp_files > 0)
WHERE temp_bytes >= 1073741824 {top(10, 'temp_bytes DESC, datname')}""",
)
def _(t):
    return P.temp_file_usage(t["t_databases"], threshold_gb=1)


@query(
    "p6_database_io",
    ["t_databases"],
    f"""SELECT {K}, datname, temp_files, temp_bytes, {pretty('temp_bytes')} AS temp_bytes_pretty, blks_read, blks_hit, blks_read + blks_hit AS total_blks,
  blk_read_time, blk_write_time FROM t_databases""",
)
def _(t):
    return P.io_statistics(t["t_databases"], t["t_io_contexts"])["database"]


@query(
    "p6_io_by_context",
    ["t_io_contexts"],
    f"""SELECT *, {pretty('read_bytes')} AS read_bytes_pretty, {pretty('write_bytes')} AS write_bytes_pretty, {pretty('extend_bytes')} AS extend_bytes_pretty
FROM t_io_contexts WHERE backend_type IS NOT NULL""",
)
def _(t):
    return P.io_statistics(t["t_databases"], t["t_io_contexts"])["by_context"]


_VISIBLE = "(operation <> 'vacuum' OR (schemaname NOT IN ('pg_catalog', 'information_schema') AND relname NOT LIKE 'pg_toast%'))"
_V = "p.operation = 'vacuum'"


def _progress(t, **options) -> dict:
    return P.operation_progress(t["t_progress"], t["t_activity"], **options)


_SHOWN = "schemaname NOT IN ('pg_catalog', 'information_schema')"


@query(
    "p7_analyze_progress",
    ["t_progress"],
    f"""SELECT {K}, pid, datname, relname, phase, blocks_total AS sample_blks_total, blocks_scanned AS sample_blks_scanned,
  {pct('blocks_scanned', 'blocks_total')} AS scan_progress_pct, child_tables_total, child_tables_done, delay_time FROM t_progress WHERE operation = 'analyze'""",
)
def _(t):
    return _progress(t, operation="analyze")["analyze"]


@query(
    "p7_create_index_progress",
    ["t_progress"],
    f"""SELECT {K}, pid, datname, relname AS table_name, index_name, command, phase, blocks_total, blocks_done, tuples_total, tuples_done, partitions_total, partitions_done
FROM t_progress WHERE operation = 'create_index'""",
)
def _(t):
    return _progress(t, operation="create-index")["create_index"]


@query(
    "p7_cluster_progress",
    ["t_progress"],
    f"""SELECT {K}, pid, datname, relname, command, phase, blocks_total AS heap_blks_total, heap_tuples_scanned, heap_tuples_written, cluster_index_relid
FROM t_progress WHERE operation = 'cluster'""",
)
def _(t):
    return _progress(t, operation="cluster")["cluster"]


def _vacuum_progress(where: str) -> str:
    return f"""SELECT {K}, pid, p.datname AS database, schemaname AS schema_name, relname AS table_name, phase, blocks_total AS heap_blks_total,
  blocks_scanned AS heap_blks_scanned, blocks_done AS heap_blks_vacuumed, index_vacuum_count, max_dead_tuples, num_dead_tuples,
  {pct0('blocks_scanned', 'blocks_total')} AS scan_progress_pct, {pct0('blocks_done', 'blocks_total')} AS vacuum_progress_pct, query, state,
  {age('snapshot_ts', 'xact_start')} AS duration_seconds, wait_event_type, wait_event
FROM t_progress p LEFT JOIN t_activity a USING ({K}, pid) WHERE operation = 'vacuum' AND {where}"""


@query("p7_vacuum_progress", ["t_progress", "t_activity"], _vacuum_progress(f"{_SHOWN} AND relname NOT LIKE 'pg_toast%'"))
def _(t):
    return _progress(t)["vacuum"]


@query("p7_vacuum_progress_with_toast", ["t_progress", "t_activity"], _vacuum_progress(f"{_SHOWN} AND relname IS NOT NULL"))
def _(t):
    return _progress(t, operation="vacuum", include_toast=True)["vacuum"]


@query(
    "p7_operation_progress",
    ["t_progress", "t_activity"],
    f"""SELECT p.cluster_id, p.snapshot_ts, p.operation, p.pid, p.datname, p.schemaname, p.relname, p.index_name, p.phase, p.blocks_total, p.blocks_scanned, p.blocks_done,
  CASE WHEN {_V} THEN {pct0('p.blocks_scanned', 'p.blocks_total')} WHEN p.operation = 'analyze' THEN {pct('p.blocks_scanned', 'p.blocks_total')} END AS scan_progress_pct,
  CASE WHEN {_V} THEN {pct0('p.blocks_done', 'p.blocks_total')} END AS vacuum_progress_pct,
  CASE WHEN {_V} THEN {age('p.snapshot_ts', 'a.xact_start')} END AS duration_seconds,
  CASE WHEN {_V} THEN a.query END AS query, CASE WHEN {_V} THEN a.state END AS state, CASE WHEN {_V} THEN a.wait_event_type END AS wait_event_type,
  CASE WHEN {_V} THEN a.wait_event END AS wait_event
FROM t_progress p LEFT JOIN t_activity a ON a.cluster_id = p.cluster_id AND a.snapshot_ts = p.snapshot_ts AND a.pid = p.pid
WHERE {_VISIBLE.replace('operation', 'p.operation').replace('schemaname', 'p.schemaname').replace('relname', 'p.relname')}""",
)
def _(t):
    return _progress(t)["operations"]


@query(
    "p7_progress_counts",
    ["t_progress"],
    f"""SELECT {K}, count(*) FILTER (WHERE operation = 'analyze') AS analyze_count, count(*) FILTER (WHERE operation = 'create_index') AS create_index_count,
  count(*) FILTER (WHERE operation = 'cluster') AS cluster_count, count(*) FILTER (WHERE operation = 'vacuum') AS vacuum_count, count(*) AS total_count
FROM t_progress WHERE {_VISIBLE} GROUP BY {K}""",
)
def _(t):
    return _progress(t)["summary"]


@query(
    "p8_wal_statistics",
    ["t_counters"],
    f"SELECT {K}, wal_records, wal_fpi, wal_bytes, {pretty('wal_bytes')} AS wal_bytes_pretty, wal_buffers_full FROM t_counters",
)
def _(t):
    return P.wal_statistics(t["t_counters"])


@query(
    "p9_slru_stats",
    ["t_slru"],
    f"SELECT * FROM t_slru WHERE blks_read > 0 OR blks_written > 0 OR flushes > 0 {top(10, 'blks_read DESC, name')}",
)
def _(t):
    return P.slru_stats(t["t_slru"])


@query(
    "p10_user_function_stats",
    ["t_functions"],
    f"""SELECT {K}, funcid, schemaname, funcname, calls, total_time_us / 1000::DOUBLE AS total_time_ms, self_time_us / 1000::DOUBLE AS self_time_ms,
  {pct('total_time_us', '100000 * calls')} AS avg_time_ms FROM t_functions WHERE calls > 0 {top(10, 'total_time_us DESC, funcid')}""",
)
def _(t):
    return P.user_function_stats(t["t_functions"])


@query(
    "p11_recovery_conflicts",
    ["t_databases"],
    f"""SELECT {K}, datname, confl_tablespace, confl_lock, confl_snapshot, confl_bufferpin, confl_deadlock, confl_active_logicalslot FROM t_databases
WHERE confl_tablespace + confl_lock + confl_snapshot + confl_bufferpin + confl_deadlock > 0""",
)
def _(t):
    return P.recovery_conflicts(t["t_databases"])


def checkpointer(t):
    return checkpointer_view(t["t_counters"])


def checkpointer_view(counters):
    """The checkpointer view of the daily counters."""
    return counters.select(
        "cluster_id",
        "snapshot_ts",
        F.col("checkpoints_timed").alias("num_timed"),
        F.col("checkpoints_req").alias("num_requested"),
        (F.col("checkpoints_timed") + F.col("checkpoints_req")).alias("num_done"),
        "write_time_ms",
        "sync_time_ms",
        F.col("buffers_checkpoint").alias("buffers_written"),
        "slru_written",
    )


_CHECKPOINTER_VIEW = f"""(SELECT {K}, checkpoints_timed AS num_timed, checkpoints_req AS num_requested, checkpoints_timed + checkpoints_req AS num_done,
  write_time_ms, sync_time_ms, buffers_checkpoint AS buffers_written, slru_written FROM t_counters)"""


@query(
    "p12_checkpointer_stats",
    ["t_counters"],
    f"""SELECT *, coalesce({pct('write_time_ms', '100 * num_done')}, 0) AS avg_write_time_per_checkpoint_ms,
  coalesce({pct('sync_time_ms', '100 * num_done')}, 0) AS avg_sync_time_per_checkpoint_ms,
  CASE WHEN num_timed > 0 AND num_requested > num_timed * 2 THEN 'WARNING' WHEN write_time_ms > 10000 OR sync_time_ms > 10000 THEN 'WARNING' ELSE 'OK' END AS checkpointer_status
FROM {_CHECKPOINTER_VIEW}""",
)
def _(t):
    return P.checkpointer_stats(checkpointer(t))


# Every counter report over growth: the check is that of the totals, over a plain lag of each series.
_CONTEXT = list(P.IO_CONTEXT_COUNTERS)
_CONFLICTS = [c for c in P.DATABASE_COUNTERS if c.startswith("confl_")]
_INTERVALS = {
    "p2_rollback_rate": ("t_databases", "cluster_id, datname", ["xact_commit", "xact_rollback"], lambda t: P.rollback_rate(t["t_databases"], mode="interval")),
    "p5_temp_file_usage": ("t_databases", "cluster_id, datname", ["temp_files", "temp_bytes"], lambda t: P.temp_file_usage(t["t_databases"], threshold_gb=1, mode="interval")),
    "p6_database_io": (
        "t_databases",
        "cluster_id, datname",
        ["temp_files", "temp_bytes", "blks_read", "blks_hit", "blk_read_time", "blk_write_time"],
        lambda t: P.io_statistics(t["t_databases"], t["t_io_contexts"], mode="interval")["database"],
    ),
    "p6_io_by_context": (
        "t_io_contexts",
        "cluster_id, backend_type, object, context",
        _CONTEXT,
        lambda t: P.io_statistics(t["t_databases"], t["t_io_contexts"], mode="interval")["by_context"],
    ),
    "p8_wal_statistics": ("t_counters", "cluster_id", ["wal_records", "wal_fpi", "wal_bytes", "wal_buffers_full"], lambda t: P.wal_statistics(t["t_counters"], mode="interval")),
    "p9_slru_stats": ("t_slru", "cluster_id, name", list(P.SLRU_COUNTERS), lambda t: P.slru_stats(t["t_slru"], mode="interval")),
    "p10_user_function_stats": ("t_functions", "cluster_id, funcid", ["calls", "total_time_us", "self_time_us"], lambda t: P.user_function_stats(t["t_functions"], mode="interval")),
    "p11_recovery_conflicts": ("t_databases", "cluster_id, datname", _CONFLICTS, lambda t: P.recovery_conflicts(t["t_databases"], mode="interval")),
    "p12_checkpointer_stats": (
        _CHECKPOINTER_VIEW,
        "cluster_id",
        ["num_timed", "num_requested", "num_done", "write_time_ms", "sync_time_ms", "buffers_written", "slru_written"],
        lambda t: P.checkpointer_stats(checkpointer(t), mode="interval"),
    ),
}


def register_intervals(reports: dict) -> None:
    for name, (table, ids, counters, build) in reports.items():
        tables, sql = CHECKS[name]
        query(f"{name}_interval", tables, sql.replace(f"FROM {table}", f"FROM {_grown(table, ids, counters)}"))(build)


register_intervals(_INTERVALS)


def _statements(order: str, n: int = 10) -> str:
    return f"""SELECT {K}, queryid, left(query, 500) AS query_text, calls, {pct('total_exec_us', '100000 * calls')} AS mean_time_ms,
  {pct('min_exec_us', '100000')} AS min_time_ms, {pct('max_exec_us', '100000')} AS max_time_ms, {pct('stddev_exec_us', '100000')} AS stddev_time_ms,
  rows_returned AS rows, shared_blks_hit, shared_blks_read, {hit('shared_blks_hit', 'shared_blks_read')} AS cache_hit_ratio, temp_blks_read, temp_blks_written
FROM t_statements WHERE calls >= 1 AND query NOT LIKE '%pg_stat_statements%' AND query NOT LIKE '%pg_catalog%' AND query NOT LIKE '%information_schema%'
  AND query NOT LIKE '%pg_toast%' {top(n, order)}"""


_MEAN = "total_exec_us / calls::DOUBLE DESC NULLS FIRST, queryid"


@query("p13_top_statements", ["t_statements"], _statements(_MEAN))
def _(t):
    return P.top_statements(t["t_statements"])


@query("p13_top_statements_by_calls", ["t_statements"], _statements("calls DESC, queryid"))
def _(t):
    return P.top_statements(t["t_statements"], order_by="calls")


@query("p13_top_statements_by_rows", ["t_statements"], _statements("rows_returned DESC, queryid"))
def _(t):
    return P.top_statements(t["t_statements"], order_by="rows")


@query(
    "p13_statements_summary",
    ["t_statements"],
    f"SELECT {K}, count(*) AS total_queries_returned FROM ({_statements(_MEAN)}) GROUP BY {K}",
)
def _(t):
    return P.statements_summary(P.top_statements(t["t_statements"]))


@query(
    "d3_high_read_statements",
    ["t_statements"],
    f"""SELECT {K}, queryid, query, calls, shared_blks_read, shared_blks_hit, shared_blks_read / (shared_blks_hit + shared_blks_read)::DOUBLE * 100 AS read_percentage
FROM t_statements WHERE shared_blks_read + shared_blks_hit > 1000 {top(10, 'shared_blks_read DESC, queryid')}""",
)
def _(t):
    return P.high_read_statements(t["t_statements"])


# --- tables -------------------------------------------------------------------------------------

_IDX = "coalesce(idx_scan, 0)"
_REPORT = f"""SELECT {K}, relname AS table_name, schemaname AS schema_name, {pretty('table_size_bytes')} AS table_size, {pretty('indexes_size_bytes')} AS indexes_size,
  {pretty('total_size_bytes')} AS total_size, total_size_bytes, n_live_tup, n_dead_tup, {pct0('n_dead_tup', 'n_live_tup')} AS dead_tuple_ratio, seq_scan, seq_tup_read, idx_scan, idx_tup_fetch,
  {pct0(_IDX, f'seq_scan + {_IDX}')} AS index_scan_ratio, last_vacuum, last_autovacuum, last_analyze, last_autoanalyze, vacuum_count, autovacuum_count, analyze_count, autoanalyze_count
FROM t_tables WHERE relkind = 'r' AND schemaname = 'public' AND schemaname NOT IN {SYSTEM}"""


def _stats(t) -> dict:
    return P.table_stats(t["t_tables"], t["t_indexes"])


@query("p16_table_stats", ["t_tables"], _REPORT)
def _(t):
    return _stats(t)["tables"]


@query("p16_table_count", ["t_tables"], f"SELECT {K}, count(*) AS table_count FROM ({_REPORT}) GROUP BY {K}")
def _(t):
    return _stats(t)["summary"]


@query(
    "p16_table_indexes",
    ["t_indexes"],
    f"""SELECT {K}, relname AS table_name, index_name, idx_scan AS scans, idx_tup_read AS tuples_read, idx_tup_fetch AS tuples_fetched, {pretty('size_bytes')} AS size, size_bytes, definition
FROM t_indexes WHERE schemaname = 'public'""",
)
def _(t):
    return P.table_index_report(t["t_indexes"])


def _one_table(t) -> dict:
    return P.table_stats(t["t_tables"], t["t_indexes"], table="Brand_11_large")


@query("p16_one_table", ["t_tables"], f"{_REPORT} AND relname ILIKE 'Brand_11_large'")
def _(t):
    return _one_table(t)["tables"]


@query(
    "p16_one_table_indexes",
    ["t_indexes"],
    f"""SELECT {K}, relname AS table_name, index_name, idx_scan AS scans, idx_tup_read AS tuples_read, idx_tup_fetch AS tuples_fetched, {pretty('size_bytes')} AS size, size_bytes, definition
FROM t_indexes WHERE schemaname = 'public' AND relname = 'Brand_11_large'""",
)
def _(t):
    return _one_table(t)["indexes"]


_NEEDS = {
    "needs_vacuum": "dead_tuple_ratio > 10",
    "needs_analyze": "coalesce(n_live_tup, 0) > 1000 AND coalesce(last_analyze, last_autoanalyze) IS NULL",
    "low_index_usage": "coalesce(seq_scan, 0) > 100 AND index_scan_ratio < 50 AND coalesce(n_live_tup, 0) > 10000",
}


@query(
    "p16_table_findings",
    ["t_tables"],
    "SELECT * FROM (WITH r AS (" + _REPORT + ") "
    + " UNION ALL ".join(
        [
            rule("table_stats", "needs_vacuum", "warning", "table_name", "dead_tuple_ratio", f"table_name || ': dead rows at ' || {fixed('dead_tuple_ratio', 2)} || '%'", f"FROM r WHERE {_NEEDS['needs_vacuum']}"),
            rule("table_stats", "needs_analyze", "warning", "table_name", "coalesce(n_live_tup, 0)", "table_name || ': never analyzed'", f"FROM r WHERE {_NEEDS['needs_analyze']}"),
            rule("table_stats", "low_index_usage", "warning", "table_name", "index_scan_ratio", f"table_name || ': index scans at ' || {fixed('index_scan_ratio', 2)} || '%'", f"FROM r WHERE {_NEEDS['low_index_usage']}"),
        ]
    )
    + ")",
)
def _(t):
    return _stats(t)["findings"]


def _advice(name: str, n: int) -> str:
    order = "total_size_bytes DESC NULLS FIRST, schema_name, table_name"
    return f"""SELECT {K}, '{name}' AS rule, count(*) AS tables, array_to_string((list(table_name ORDER BY {order}))[1:{n}], ', ') AS first_tables
FROM r WHERE {_NEEDS[name]} GROUP BY {K}"""


@query(
    "p16_table_advice",
    ["t_tables"],
    f"SELECT * FROM (WITH r AS ({_REPORT}) " + " UNION ALL ".join([_advice("needs_vacuum", 5), _advice("needs_analyze", 5), _advice("low_index_usage", 3)]) + ")",
)
def _(t):
    return _stats(t)["advice"]


@query(
    "d5_io_hotspots",
    ["t_tables"],
    f"""SELECT {K}, relname AS table_name, seq_scan, idx_scan, n_dead_tup, n_live_tup, n_tup_ins, n_tup_upd, n_tup_del, last_vacuum, last_autovacuum
FROM t_tables WHERE schemaname = 'public'""",
)
def _(t):
    return P.io_hotspots(t["t_tables"])


@query(
    "d5_relation_sizes",
    ["t_tables"],
    f"""SELECT {K}, schemaname, relname AS table_name, {pretty('table_size_bytes')} AS table_size, {pretty('indexes_size_bytes')} AS indexes_size,
  {pretty('total_size_bytes')} AS total_size, total_size_bytes FROM t_tables""",
)
def _(t):
    return P.relation_sizes(t["t_tables"])


# --- disk I/O -----------------------------------------------------------------------------------


def _sum(c: str) -> str:
    return f"coalesce(sum({c})::BIGINT, 0)"


_POOL = f"""SELECT {K}, heap_blocks_read, heap_blocks_hit, index_blocks_read, index_blocks_hit, toast_blocks_read, toast_blocks_hit,
  coalesce(nullif({hit('heap_blocks_hit', 'heap_blocks_read')}, 0), 100) AS heap_hit_ratio, coalesce(nullif({hit('index_blocks_hit', 'index_blocks_read')}, 0), 100) AS index_hit_ratio
FROM (SELECT {K}, {_sum('heap_blks_read')} AS heap_blocks_read, {_sum('heap_blks_hit')} AS heap_blocks_hit, {_sum('idx_blks_read')} AS index_blocks_read,
  {_sum('idx_blks_hit')} AS index_blocks_hit, {_sum('toast_blks_read')} AS toast_blocks_read, {_sum('toast_blks_hit')} AS toast_blocks_hit FROM t_tables GROUP BY {K})"""
_BIG = f"t_tables WHERE schemaname = 'public' AND schemaname NOT IN {SYSTEM} AND total_size_bytes >= 10737418"
_TABLE_IO = f"""SELECT a.cluster_id, a.snapshot_ts, a.relname AS table_name, coalesce(heap_blks_read, 0) AS heap_blocks_read, coalesce(heap_blks_hit, 0) AS heap_blocks_hit,
  coalesce(nullif({hit('heap_blks_hit', 'heap_blks_read')}, 0), 100) AS heap_hit_ratio, coalesce(idx_blks_read, 0) AS index_blocks_read, coalesce(idx_blks_hit, 0) AS index_blocks_hit,
  coalesce(nullif({hit('idx_blks_hit', 'idx_blks_read')}, 0), 100) AS index_hit_ratio, coalesce(heap_blks_read + coalesce(idx_blks_read, 0), 0) AS total_physical_reads,
  coalesce(b.seq_scan, 0) AS seq_scans, coalesce(b.seq_tup_read, 0) AS seq_tuples_read, coalesce(b.idx_scan, 0) AS idx_scans, coalesce(b.idx_tup_fetch, 0) AS idx_tuples_fetched,
  coalesce({pct0('b.seq_scan', 'b.seq_scan + coalesce(b.idx_scan, 0)')}, 0) AS seq_scan_ratio, coalesce(b.n_live_tup, 0) AS live_tuples
FROM (SELECT {K}, relname, heap_blks_read, heap_blks_hit, idx_blks_read, idx_blks_hit FROM {_BIG} {top(20, 'heap_blks_read + coalesce(idx_blks_read, 0) DESC NULLS FIRST, relname')}) a
LEFT JOIN (SELECT {K}, relname, seq_scan, seq_tup_read, idx_scan, idx_tup_fetch, n_live_tup FROM {_BIG} {top(20, 'seq_tup_read DESC NULLS FIRST, relname')}) b USING ({K}, relname)"""
_INDEX_IO = f"""SELECT {K}, index_name, relname AS table_name, coalesce(idx_blks_read, 0) AS blocks_read, coalesce(idx_blks_hit, 0) AS blocks_hit,
  coalesce(nullif({hit('idx_blks_hit', 'idx_blks_read')}, 0), 100) AS hit_ratio FROM t_indexes WHERE schemaname = 'public' AND size_bytes >= 10737418
{top(20, 'idx_blks_read DESC NULLS FIRST, index_name')}"""
_IO_NOTES = " UNION ALL ".join(
    [
        rule("disk_io", "heap_hit_low", "warning", "'buffer_pool'", "heap_hit_ratio", f"'heap cache hit ratio ' || {fixed('heap_hit_ratio', 2)} || '%'", "FROM pool WHERE heap_hit_ratio < 90"),
        rule("disk_io", "heap_hit_advice", "advice", "'buffer_pool'", "heap_hit_ratio", "'raise shared_buffers'", "FROM pool WHERE heap_hit_ratio < 90"),
        rule("disk_io", "index_hit_low", "warning", "'buffer_pool'", "index_hit_ratio", f"'index cache hit ratio ' || {fixed('index_hit_ratio', 2)} || '%'", "FROM pool WHERE index_hit_ratio < 95"),
        rule("disk_io", "index_hit_advice", "advice", "'buffer_pool'", "index_hit_ratio", "'keep hot indexes in cache'", "FROM pool WHERE index_hit_ratio < 95"),
        rule("disk_io", "table_reads", "warning", "table_name", "heap_hit_ratio", f"'table ' || table_name || ': ' || total_physical_reads || ' reads at ' || {fixed('heap_hit_ratio', 2)} || '% cache hits'", "FROM tio WHERE total_physical_reads > 1000 AND heap_hit_ratio < 85"),
        rule("disk_io", "sequential_scans", "warning", "table_name", "seq_scan_ratio", f"'table ' || table_name || ': ' || {fixed('seq_scan_ratio', 2)} || '% sequential scans over ' || live_tuples || ' rows'", "FROM tio WHERE seq_scan_ratio > 80 AND live_tuples > 10000"),
        rule("disk_io", "index_missing", "advice", "table_name", "seq_scan_ratio", "'add indexes to table ' || table_name", "FROM tio WHERE seq_scan_ratio > 80 AND live_tuples > 10000"),
        rule("disk_io", "index_reads", "warning", "index_name", "hit_ratio", f"'index ' || index_name || ': cache hit ratio ' || {fixed('hit_ratio', 2)} || '%'", "FROM iio WHERE blocks_read > 1000 AND hit_ratio < 90"),
    ]
)
_IO_WITH = f"WITH pool AS ({_POOL}), tio AS ({_TABLE_IO}), iio AS ({_INDEX_IO})"


def _io(t) -> dict:
    # 0.01 GB, so that the test tables pass the size filter.
    return P.disk_io_analysis(t["t_tables"], t["t_indexes"], min_size_gb=0.01)


@query("p17_buffer_pool_io", ["t_tables"], _POOL)
def _(t):
    return _io(t)["buffer_pool"]


@query("p18_table_io", ["t_tables"], _TABLE_IO)
def _(t):
    return _io(t)["tables"]


@query("p19_index_io", ["t_indexes"], _INDEX_IO)
def _(t):
    return _io(t)["indexes"]


_TABLE_IDS, _INDEX_IDS = "cluster_id, schemaname, relname", "cluster_id, schemaname, relname, index_name"
_TABLE_GROWTH = [c for c in P.TABLE_COUNTERS if not c.startswith("tidx_")]
register_intervals(
    {
        "p17_buffer_pool_io": ("t_tables", _TABLE_IDS, _TABLE_GROWTH, lambda t: P.buffer_pool_io(t["t_tables"], mode="interval")),
        "p18_table_io": ("t_tables", _TABLE_IDS, _TABLE_GROWTH, lambda t: P.table_io(t["t_tables"], min_size_gb=0.01, mode="interval")),
        "p19_index_io": ("t_indexes", _INDEX_IDS, ["idx_scan", "idx_blks_read", "idx_blks_hit"], lambda t: P.index_io(t["t_indexes"], min_size_gb=0.01, mode="interval")),
    }
)


@query("p20_disk_io_findings", ["t_tables", "t_indexes"], f"SELECT DISTINCT * FROM ({_IO_WITH} {_IO_NOTES})")
def _(t):
    return _io(t)["findings"]


@query(
    "p20_disk_io_summary",
    ["t_tables", "t_indexes"],
    f"""SELECT * FROM ({_IO_WITH}, notes AS (SELECT DISTINCT {K}, severity, message FROM ({_IO_NOTES}))
SELECT {K}, heap_hit_ratio AS heap_cache_hit_ratio, index_hit_ratio AS index_cache_hit_ratio, count(*) FILTER (WHERE severity <> 'advice') AS total_issues,
  count(*) FILTER (WHERE severity = 'advice') AS total_recommendations FROM pool LEFT JOIN notes USING ({K}) GROUP BY ALL)""",
)
def _(t):
    return _io(t)["summary"]
