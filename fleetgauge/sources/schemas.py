"""Schemas of the telemetry tables: one per family of statistics views.

Every table is append-only and carries ``cluster_id`` and ``snapshot_ts``; a collector stamps all
rows of one run with the same instant.
"""

from __future__ import annotations

from pyspark.sql import types as T

_KEYS = "cluster_id string, snapshot_ts timestamp"

# Columns of each telemetry table, without the two keys.
_COLUMNS = {
    "activity": (
        "pid long, datname string, usename string, client_addr string, state string, backend_type string, "
        "backend_start timestamp, query_start timestamp, xact_start timestamp, wait_event_type string, "
        "wait_event string, query string, blocking_pids array<long>, ssl boolean, ssl_version string, "
        "ssl_cipher string, gss_authenticated boolean, gss_encrypted boolean"
    ),
    "prepared_xacts": "gid string, owner string, database string, prepared timestamp, transaction long",
    "locks": (
        "pid long, locktype string, database long, relation long, page long, tuple long, virtualxid string, "
        "transactionid long, classid long, objid long, objsubid long, mode string, granted boolean"
    ),
    "databases": (
        "datname string, datistemplate boolean, datallowconn boolean, blks_read long, blks_hit long, "
        "blk_read_time long, blk_write_time long, xact_commit long, xact_rollback long, temp_files long, "
        "temp_bytes long, deadlocks long, xid_age long, mxid_age long, datminmxid long, size_bytes long, "
        "confl_tablespace long, confl_lock long, confl_snapshot long, confl_bufferpin long, "
        "confl_deadlock long, confl_active_logicalslot long"
    ),
    "tables": (
        "schemaname string, relname string, relkind string, relpages long, table_size_bytes long, "
        "indexes_size_bytes long, total_size_bytes long, n_live_tup long, n_dead_tup long, "
        "n_mod_since_analyze long, n_tup_ins long, n_tup_upd long, n_tup_del long, seq_scan long, "
        "seq_tup_read long, idx_scan long, idx_tup_fetch long, last_vacuum timestamp, "
        "last_autovacuum timestamp, last_analyze timestamp, last_autoanalyze timestamp, vacuum_count long, "
        "autovacuum_count long, analyze_count long, autoanalyze_count long, heap_blks_read long, "
        "heap_blks_hit long, idx_blks_read long, idx_blks_hit long, toast_blks_read long, "
        "toast_blks_hit long, tidx_blks_read long, tidx_blks_hit long, xid_age long, mxid_age long, "
        "relminmxid long, toast_relname string, toast_size_bytes long"
    ),
    "indexes": (
        "schemaname string, relname string, index_name string, access_method string, columns array<string>, "
        "is_unique boolean, is_primary boolean, is_valid boolean, size_bytes long, relpages long, "
        "definition string, idx_scan long, idx_tup_read long, idx_tup_fetch long, idx_blks_read long, "
        "idx_blks_hit long"
    ),
    "statements": (
        "queryid long, query string, calls long, total_exec_us long, min_exec_us long, max_exec_us long, "
        "stddev_exec_us long, rows_returned long, shared_blks_hit long, shared_blks_read long, "
        "temp_blks_read long, temp_blks_written long"
    ),
    "settings": (
        "name string, setting string, unit string, category string, short_desc string, context string, "
        "vartype string, source string, boot_val string, reset_val string"
    ),
    "io_contexts": (
        "backend_type string, object string, context string, reads long, read_bytes long, writes long, "
        "write_bytes long, extends long, extend_bytes long, hits long, evictions long, reuses long, "
        "fsyncs long, fsync_time long"
    ),
    "bgwriter": (
        "checkpoints_timed long, checkpoints_req long, buffers_checkpoint long, buffers_clean long, "
        "buffers_backend long, maxwritten_clean long, buffers_alloc long, stats_reset timestamp"
    ),
    "checkpointer": (
        "num_timed long, num_requested long, num_done long, write_time_ms long, sync_time_ms long, "
        "buffers_written long, slru_written long"
    ),
    "wal": "wal_records long, wal_fpi long, wal_bytes long, wal_buffers_full long",
    "wal_files": "file_no long, size long",
    "slru": (
        "name string, blks_zeroed long, blks_hit long, blks_read long, blks_written long, blks_exists long, "
        "flushes long, truncates long"
    ),
    "functions": (
        "funcid long, schemaname string, funcname string, calls long, total_time_us long, self_time_us long"
    ),
    "replication": (
        "application_name string, client_addr string, state string, sync_state string, sync_priority long, "
        "current_lsn string, sent_lsn string, write_lsn string, flush_lsn string, replay_lsn string, "
        "write_lag string, flush_lag string, replay_lag string"
    ),
    "replication_slots": (
        "slot_name string, plugin string, slot_type string, database string, active boolean, "
        "current_lsn string, restart_lsn string"
    ),
    "subscriptions": (
        "subname string, subid long, last_msg_send_time timestamp, last_msg_receipt_time timestamp"
    ),
    "archiver": (
        "archived_count long, last_archived_wal string, last_archived_time timestamp, failed_count long, "
        "last_failed_wal string, last_failed_time timestamp, stats_reset timestamp"
    ),
    "progress": (
        "operation string, pid long, datname string, schemaname string, relname string, index_name string, "
        "phase string, blocks_total long, blocks_scanned long, blocks_done long, command string, tuples_total long, tuples_done long, "
        "partitions_total long, partitions_done long, child_tables_total long, child_tables_done long, delay_time double, "
        "heap_tuples_scanned long, heap_tuples_written long, cluster_index_relid long, index_vacuum_count long, "
        "max_dead_tuples long, num_dead_tuples long"
    ),
    "sequences": (
        "schemaname string, sequence_name string, last_val long, max_val long, seqcycle boolean"
    ),
    "heap_samples": (
        "schemaname string, relname string, table_len long, tuple_count long, tuple_len long, "
        "tuple_percent double, dead_tuple_count long, dead_tuple_len long, dead_tuple_percent double, "
        "free_space long, free_percent double, approx_tuple_count long, approx_tuple_len long, "
        "approx_tuple_percent double, approx_free_space long, approx_free_percent double, scanned_percent double"
    ),
    "index_samples": (
        "schemaname string, relname string, index_name string, access_method string, size_bytes long, "
        "avg_leaf_density double, leaf_pages long, empty_pages long, deleted_pages long, "
        "leaf_fragmentation double, pending_pages long, pending_tuples long, bucket_pages long, "
        "overflow_pages long, bitmap_pages long, unused_pages long, live_items long, dead_items long, "
        "hash_free_percent double"
    ),
    "page_free_space": "relname string, blkno long, avail long",
    "plans": "plan_id long, plan string",
    "column_usage": "queryid long, table_name string, column_name string",
    "column_widths": "table_name string, column_name string, avg_width long",
    "table_rows": "table_name string, row_count long",
    "what_if": (
        "queryid long, table_name string, candidate_columns string, cost_before double, cost_after double, "
        "would_use boolean"
    ),
}


def _parse(text: str) -> T.StructType:
    kinds = {
        "string": T.StringType(),
        "long": T.LongType(),
        "double": T.DoubleType(),
        "boolean": T.BooleanType(),
        "timestamp": T.TimestampType(),
        "array<long>": T.ArrayType(T.LongType()),
        "array<string>": T.ArrayType(T.StringType()),
    }
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


SCHEMAS: dict[str, T.StructType] = {name: _parse(f"{_KEYS}, {cols}") for name, cols in _COLUMNS.items()}
