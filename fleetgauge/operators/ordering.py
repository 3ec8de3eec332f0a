"""Report order of the operators' rows.

A DataFrame has no order of its own, and sorting every report would add a range shuffle nobody may
need. ``in_report_order`` sorts a result the way its report is read, with the keys in front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS

# Direction and column; "desc" puts unknown values first, as the databases' own reports do.
REPORT_ORDER: dict[str, list[tuple[str, str]]] = {
    "xid_wraparound": [("desc", "xid_age"), ("asc", "datname")],
    "mxid_wraparound": [("desc", "mxid_age"), ("asc", "datname")],
    "connection_security": [("asc", "connection_type"), ("asc", "datname"), ("asc", "usename")],
    "wait_events": [("desc", "count"), ("asc", "wait_event_type")],
    "unused_indexes": [("desc", "size_bytes"), ("asc", "index_name")],
    "long_running_queries": [("desc", "duration_seconds"), ("asc", "pid")],
    "idle_in_transaction": [("desc", "transaction_seconds"), ("asc", "pid")],
    "long_running_transactions": [("desc", "transaction_seconds"), ("asc", "pid")],
    "long_running_prepared": [("asc", "prepared"), ("asc", "gid")],
    "lock_waiters": [("asc", "blocked_pid"), ("asc", "blocking_pid")],
    "active_queries": [("active_first", "state"), ("desc", "duration_seconds"), ("asc", "pid")],
    "table_hotspots": [("desc", "total_dml"), ("desc", "total_scans"), ("asc", "relname")],
    "temp_file_usage": [("desc", "temp_bytes"), ("asc", "datname")],
    "io_by_context": [("desc", "reads + writes"), ("asc", "backend_type")],
    "operation_progress": [("asc", "operation"), ("desc", "blocks_total"), ("asc", "pid")],
    "slru_stats": [("desc", "blks_read"), ("asc", "name")],
    "user_function_stats": [("desc", "total_time_ms"), ("asc", "funcid")],
    "recovery_conflicts": [
        ("desc", "confl_tablespace + confl_lock + confl_snapshot + confl_bufferpin + confl_deadlock"),
        ("asc", "datname"),
    ],
    "high_read_statements": [("desc", "shared_blks_read"), ("asc", "queryid")],
    "table_report": [("desc", "total_size_bytes"), ("asc", "table_name")],
    "table_index_report": [("desc", "scans"), ("asc", "index_name")],
    "io_hotspots": [("desc", "seq_scan"), ("asc", "table_name")],
    "relation_sizes": [("desc", "total_size_bytes"), ("asc", "table_name")],
    "table_io": [("desc", "total_physical_reads"), ("asc", "table_name")],
    "index_io": [("desc", "blocks_read"), ("asc", "index_name")],
    "logical_replication_status": [("asc", "subname")],
    "top_objects_by_size": [("desc", "type"), ("desc", "size_bytes"), ("asc", "object_name")],
    "stale_statistics": [("desc", "modified_percent"), ("asc", "relname")],
    "database_sizes": [("desc", "size_bytes"), ("asc", "datname")],
    "sequence_exhaustion": [("desc", "percentage_used"), ("asc", "sequence_name")],
    "freeze_prediction": [("asc", "freeze_status"), ("asc", "xid_remain_ages"), ("asc", "table_name")],
    "list_indexes": [("desc", "is_primary"), ("asc", "index_name")],
    "table_bloat": [("desc", "wasted_space_bytes"), ("asc", "table_name")],
    "index_bloat": [("desc", "estimated_bloat_percent"), ("asc", "index_name")],
    "tables_needing_vacuum": [("desc", "n_dead_tup"), ("asc", "table_name")],
    "tables_near_wraparound": [("desc", "xid_age"), ("asc", "table_name")],
    "autovacuum_trigger": [("desc", "n_dead_tup"), ("asc", "table_name")],
    "vacuum_history": [("desc_last", "last_vacuumed"), ("asc", "table_name")],
    "recommend_layout": [("desc_last", "estimated_improvement_percent"), ("asc", "table_name"), ("asc", "columns")],
}


def in_report_order(df: DataFrame, report: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """``df`` sorted by its keys, then in the order of the named report."""
    order = [F.asc(k) for k in keys]
    for how, column in REPORT_ORDER[report]:
        if how == "active_first":
            order.append(F.asc(F.when(F.col(column) == "active", 0).otherwise(1)))
        elif how == "asc":
            order.append(F.asc_nulls_last(column))
        else:
            value = F.expr(column)
            order.append(value.desc_nulls_last() if how == "desc_last" else value.desc_nulls_first())
    return df.orderBy(*order)
