"""Cache, I/O, log, progress, statements, tables and indexes in use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.expressions import (
    age_seconds,
    exclude_like,
    fixed_text,
    gb_to_bytes,
    hit_ratio,
    left_text,
    not_system_schema,
    pct_ratio,
    percent,
    size_gb,
    size_pretty,
    trunc_pct,
    zero_as_missing,
)
from fleetgauge.functions.frames import Rule, counter_operator, findings, first_names, keyed_join, text, topn
from fleetgauge.sources.schemas import SCHEMAS

DATABASE_COUNTERS = (
    "xact_commit",
    "xact_rollback",
    "blks_hit",
    "blks_read",
    "blk_read_time",
    "blk_write_time",
    "temp_files",
    "temp_bytes",
    "deadlocks",
    "confl_tablespace",
    "confl_lock",
    "confl_snapshot",
    "confl_bufferpin",
    "confl_deadlock",
    "confl_active_logicalslot",
)
TABLE_COUNTERS = (
    "seq_scan",
    "seq_tup_read",
    "idx_scan",
    "idx_tup_fetch",
    "heap_blks_read",
    "heap_blks_hit",
    "idx_blks_read",
    "idx_blks_hit",
    "toast_blks_read",
    "toast_blks_hit",
    "tidx_blks_read",
    "tidx_blks_hit",
)


def _one_database(databases: DataFrame, database: str | None) -> DataFrame:
    return databases if database is None else databases.filter(F.col("datname") == database)


@counter_operator(["datname"], DATABASE_COUNTERS)
def cache_hit_rate(databases: DataFrame, database: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    traffic = F.col("blks_hit") + F.col("blks_read")
    d = _one_database(databases, database).filter(traffic > 0)
    return d.select(*keys, "datname", "blks_read", "blks_hit", percent("blks_hit", traffic).alias("hit_rate_percentage"))


@counter_operator(["datname"], DATABASE_COUNTERS)
def rollback_rate(databases: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    rate = trunc_pct("xact_rollback", F.col("xact_commit") + F.col("xact_rollback"))
    return databases.select(*keys, "datname", "xact_commit", "xact_rollback", rate.alias("rollback_percentage"))


def table_hotspots(tables: DataFrame, limit: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Most written tables; ties by scans, where unknown scans come first."""
    d = tables.select(
        *keys,
        "schemaname",
        "relname",
        (F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del")).alias("total_dml"),
        (F.col("seq_scan") + F.col("idx_scan")).alias("total_scans"),
        "n_dead_tup",
    )
    order = [F.desc_nulls_first("total_dml"), F.desc_nulls_first("total_scans"), F.asc("schemaname"), F.asc("relname")]
    return topn(d, limit, order, keys)


@counter_operator([], ["buffers_clean", "maxwritten_clean", "buffers_alloc"])
def bgwriter_stats(bgwriter: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return bgwriter.select(*keys, "buffers_clean", "maxwritten_clean", "buffers_alloc")


@counter_operator(["datname"], DATABASE_COUNTERS)
def temp_file_usage(
    databases: DataFrame, limit: int = 10, threshold_gb: float = 0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Databases with most temporary bytes; the share is of all temporary files of the key."""
    keys = list(keys)
    with_files = databases.filter(F.col("temp_files") > 0)
    totals = with_files.groupBy(*keys).agg(F.sum("temp_files").alias("_all"))
    # Cut first: the rows that meet the totals are then at most `limit` per key.
    top = topn(
        with_files.filter(F.col("temp_bytes") >= gb_to_bytes(threshold_gb)),
        limit,
        [F.desc_nulls_first("temp_bytes"), F.asc("datname")],
        keys,
    )
    return keyed_join(top, totals, keys).select(
        *keys,
        "datname",
        "temp_files",
        "temp_bytes",
        size_pretty("temp_bytes").alias("temp_bytes_pretty"),
        size_gb("temp_bytes").alias("temp_bytes_gb"),
        (F.col("temp_files") / F.col("_all")).alias("temp_files_ratio"),
    )


@counter_operator(["datname"], DATABASE_COUNTERS)
def database_io(databases: DataFrame, database: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    return _one_database(databases, database).select(
        *keys,
        "datname",
        "temp_files",
        "temp_bytes",
        size_pretty("temp_bytes").alias("temp_bytes_pretty"),
        "blks_read",
        "blks_hit",
        (F.col("blks_read") + F.col("blks_hit")).alias("total_blks"),
        "blk_read_time",
        "blk_write_time",
    )


IO_CONTEXT_COUNTERS = (
    "reads",
    "read_bytes",
    "writes",
    "write_bytes",
    "extends",
    "extend_bytes",
    "hits",
    "evictions",
    "reuses",
    "fsyncs",
    "fsync_time",
)


@counter_operator(["backend_type", "object", "context"], IO_CONTEXT_COUNTERS)
def io_by_context(io_contexts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Reads, writes and extends per backend type, object and context."""
    sizes = [c for c in ("read_bytes", "write_bytes", "extend_bytes") if c in io_contexts.columns]
    order = ("backend_type", "object", "context", "reads", "read_bytes", "writes", "write_bytes", "extends")
    tail = ("extend_bytes", "hits", "evictions", "reuses", "fsyncs", "fsync_time")
    cols = [c for c in (*order, *tail) if c in io_contexts.columns]
    return io_contexts.filter(F.col("backend_type").isNotNull()).select(
        *keys, *cols, *[size_pretty(c).alias(f"{c}_pretty") for c in sizes]
    )


def io_statistics(
    databases: DataFrame,
    io_contexts: DataFrame | None = None,
    database: str | None = None,
    mode: str = "cumulative",
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    out = {"database": database_io(databases, database, keys, mode=mode)}
    if io_contexts is not None:
        out["by_context"] = io_by_context(io_contexts, keys, mode=mode)
    return out


PROGRESS_OPERATIONS = ("analyze", "create_index", "cluster", "vacuum")

#: The views' columns of each operation, as (name, source column of the progress table).
PROGRESS_COLUMNS = {
    "analyze": (
        ("pid", "pid"),
        ("datname", "datname"),
        ("relname", "relname"),
        ("phase", "phase"),
        ("sample_blks_total", "blocks_total"),
        ("sample_blks_scanned", "blocks_scanned"),
        ("scan_progress_pct", None),
        ("child_tables_total", "child_tables_total"),
        ("child_tables_done", "child_tables_done"),
        ("delay_time", "delay_time"),
    ),
    "create_index": (
        ("pid", "pid"),
        ("datname", "datname"),
        ("table_name", "relname"),
        ("index_name", "index_name"),
        ("command", "command"),
        ("phase", "phase"),
        ("blocks_total", "blocks_total"),
        ("blocks_done", "blocks_done"),
        ("tuples_total", "tuples_total"),
        ("tuples_done", "tuples_done"),
        ("partitions_total", "partitions_total"),
        ("partitions_done", "partitions_done"),
    ),
    "cluster": (
        ("pid", "pid"),
        ("datname", "datname"),
        ("relname", "relname"),
        ("command", "command"),
        ("phase", "phase"),
        ("heap_blks_total", "blocks_total"),
        ("heap_tuples_scanned", "heap_tuples_scanned"),
        ("heap_tuples_written", "heap_tuples_written"),
        ("cluster_index_relid", "cluster_index_relid"),
    ),
    "vacuum": (
        ("pid", "pid"),
        ("database", "datname"),
        ("schema_name", "schemaname"),
        ("table_name", "relname"),
        ("phase", "phase"),
        ("heap_blks_total", "blocks_total"),
        ("heap_blks_scanned", "blocks_scanned"),
        ("heap_blks_vacuumed", "blocks_done"),
        ("index_vacuum_count", "index_vacuum_count"),
        ("max_dead_tuples", "max_dead_tuples"),
        ("num_dead_tuples", "num_dead_tuples"),
        ("scan_progress_pct", None),
        ("vacuum_progress_pct", None),
        ("query", None),
        ("state", None),
        ("duration_seconds", None),
        ("wait_event_type", None),
        ("wait_event", None),
    ),
}


def operation_progress(
    progress: DataFrame,
    activity: DataFrame,
    operation: str = "all",
    include_toast: bool = False,
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    """Running maintenance: one frame per wanted operation with that view's columns, all in one frame, and counts per operation.

    An analyze without a total has no percentage; a vacuum without one stands at 0. Columns that the progress table lacks are NULL.
    """
    keys = list(keys)
    wanted = PROGRESS_OPERATIONS if operation == "all" else (operation.replace("-", "_"),)
    unknown = set(wanted) - set(PROGRESS_OPERATIONS)
    if unknown:
        raise ValueError(f"unknown operation {operation!r}")
    declared = {f.name: f.dataType for f in SCHEMAS["progress"].fields}
    absent = {c: F.lit(None).cast(kind) for c, kind in declared.items() if c not in progress.columns and c not in KEYS}
    rows = progress.withColumns(absent).filter(F.col("operation").isin(*wanted))
    is_vacuum = F.col("operation") == "vacuum"
    hidden = F.col("schemaname").isin("pg_catalog", "information_schema")
    if not include_toast:
        hidden = hidden | F.col("relname").startswith("pg_toast")
    # A vacuum needs a known table; the other operations keep rows without one.
    rows = rows.filter(~is_vacuum | F.coalesce(F.col("relname").isNotNull() & ~hidden, F.lit(False)))
    total, scanned, done = F.col("blocks_total"), F.col("blocks_scanned"), F.col("blocks_done")
    scan_pct = F.when(is_vacuum, pct_ratio(scanned, total)).when(F.col("operation") == "analyze", percent(scanned, total))
    session_cols = ("query", "state", "wait_event_type", "wait_event")
    measures = {"scan_progress_pct": scan_pct, "vacuum_progress_pct": F.when(is_vacuum, pct_ratio(done, total))}
    # Only vacuums show their session.
    sessions = activity.select(*keys, "pid", "query", "state", "xact_start", "wait_event_type", "wait_event")

    def with_sessions(df: DataFrame) -> DataFrame:
        found = df.join(sessions, [*keys, "pid"], "left").withColumns(measures)
        age = F.when(is_vacuum, age_seconds("snapshot_ts", "xact_start"))
        return found.withColumns({"duration_seconds": age} | {c: F.when(is_vacuum, F.col(c)) for c in session_cols})

    out = {}
    for op in wanted:
        own = rows.filter(F.col("operation") == op)
        own = with_sessions(own) if op == "vacuum" else own.withColumns(measures)
        out[op] = own.select(*keys, *[F.col(source or name).alias(name) for name, source in PROGRESS_COLUMNS[op]])
    out["operations"] = with_sessions(rows).select(
        *keys,
        "operation",
        "pid",
        "datname",
        "schemaname",
        "relname",
        "index_name",
        "phase",
        "blocks_total",
        "blocks_scanned",
        "blocks_done",
        "scan_progress_pct",
        "vacuum_progress_pct",
        "duration_seconds",
        *session_cols,
    )
    counts = [F.count_if(F.col("operation") == op).alias(f"{op}_count") for op in wanted]
    out["summary"] = rows.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("total_count"))
    return out


@counter_operator([], ["wal_records", "wal_fpi", "wal_bytes", "wal_buffers_full"])
def wal_statistics(wal: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    pretty = size_pretty("wal_bytes").alias("wal_bytes_pretty")
    return wal.select(*keys, "wal_records", "wal_fpi", "wal_bytes", pretty, "wal_buffers_full")


SLRU_COUNTERS = ("blks_zeroed", "blks_hit", "blks_read", "blks_written", "blks_exists", "flushes", "truncates")


@counter_operator(["name"], SLRU_COUNTERS)
def slru_stats(slru: DataFrame, limit: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    used = slru.filter((F.col("blks_read") > 0) | (F.col("blks_written") > 0) | (F.col("flushes") > 0))
    cols = [c for c in SLRU_COUNTERS if c in slru.columns]
    return topn(used.select(*keys, "name", *cols), limit, [F.desc_nulls_first("blks_read"), F.asc("name")], keys)


@counter_operator(["funcid"], ["calls", "total_time_us", "self_time_us"])
def user_function_stats(functions: DataFrame, limit: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Functions by total time; times arrive in microseconds and are reported in milliseconds."""
    order = [F.desc_nulls_first("total_time_us"), F.asc("funcid")]
    top = topn(functions.filter(F.col("calls") > 0), limit, order, keys)
    return top.select(
        *keys,
        "funcid",
        "schemaname",
        "funcname",
        "calls",
        (F.col("total_time_us") / F.lit(1000.0)).alias("total_time_ms"),
        (F.col("self_time_us") / F.lit(1000.0)).alias("self_time_ms"),
        _mean_ms(F.col("total_time_us"), F.col("calls")).alias("avg_time_ms"),
    )


@counter_operator(["datname"], DATABASE_COUNTERS)
def recovery_conflicts(databases: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Conflict counts per database; the logical-slot count is shown but does not keep a row."""
    kinds = ("confl_tablespace", "confl_lock", "confl_snapshot", "confl_bufferpin", "confl_deadlock")
    total = sum((F.col(c) for c in kinds[1:]), F.col(kinds[0]))
    return databases.filter(total > 0).select(*keys, "datname", *kinds, "confl_active_logicalslot")


@counter_operator(
    [], ["num_timed", "num_requested", "num_done", "write_time_ms", "sync_time_ms", "buffers_written", "slru_written"]
)
def checkpointer_stats(checkpointer: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    timed, requested, done = F.col("num_timed"), F.col("num_requested"), F.col("num_done")

    def average(total: str) -> Column:
        # percent() is 100 * n / d, so a hundredfold denominator leaves the plain mean.
        return F.coalesce(percent(F.col(total), done * F.lit(100).cast("long")), F.lit(0.0))

    status = (
        F.when((timed > 0) & (requested > timed * 2), "WARNING")
        .when((F.col("write_time_ms") > 10000) | (F.col("sync_time_ms") > 10000), "WARNING")
        .otherwise("OK")
    )
    return checkpointer.select(
        *keys,
        "num_timed",
        "num_requested",
        "num_done",
        "write_time_ms",
        "sync_time_ms",
        "buffers_written",
        "slru_written",
        average("write_time_ms").alias("avg_write_time_per_checkpoint_ms"),
        average("sync_time_ms").alias("avg_sync_time_per_checkpoint_ms"),
        status.alias("checkpointer_status"),
    )


# --- statements ---------------------------------------------------------------------------------


def _mean_ms(total_us: Column, calls: Column) -> Column:
    """Microseconds per call as milliseconds: 100 * us / (100000 * calls), rounded exactly."""
    return percent(total_us, calls * F.lit(100_000).cast("long"))


def _us_as_ms(us: str) -> Column:
    """Whole microseconds as milliseconds with two decimals, half away from zero."""
    return percent(F.col(us), F.lit(100_000).cast("long"))


def top_statements(
    statements: DataFrame,
    limit: int = 10,
    min_calls: int = 1,
    min_mean_time_ms: float = 0,
    order_by: str = "mean_time",
    keys: Sequence[str] = KEYS,
    query_chars: int | None = 500,
) -> DataFrame:
    """The heaviest statements; execution times arrive in whole microseconds. ``query_chars`` cuts their texts (``None``: whole)."""
    total, calls = F.col("total_exec_us"), F.col("calls")
    mean = total / calls
    orders = {"mean_time": mean, "calls": calls, "rows": F.col("rows_returned")}
    ranked = orders.get(order_by, mean)
    kept = statements.filter(
        (calls >= min_calls)
        & (total >= calls * F.lit(int(round(min_mean_time_ms * 1000))))
        & exclude_like("query")
    )
    optional = [c for c in ("temp_blks_read", "temp_blks_written") if c in statements.columns]
    return topn(kept, limit, [ranked.desc_nulls_first(), F.asc("queryid")], keys).select(
        *keys,
        "queryid",
        (F.col("query") if query_chars is None else left_text("query", query_chars)).alias("query_text"),
        "calls",
        _mean_ms(total, calls).alias("mean_time_ms"),
        _us_as_ms("min_exec_us").alias("min_time_ms"),
        _us_as_ms("max_exec_us").alias("max_time_ms"),
        _us_as_ms("stddev_exec_us").alias("stddev_time_ms"),
        F.col("rows_returned").alias("rows"),
        "shared_blks_hit",
        "shared_blks_read",
        hit_ratio("shared_blks_hit", "shared_blks_read").alias("cache_hit_ratio"),
        *optional,
    )


def statements_summary(top: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return top.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_queries_returned"))


def high_read_statements(
    statements: DataFrame, min_blocks: int = 1000, limit: int = 10, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Statements reading most blocks from disk, with the share of blocks not found in cache."""
    hit, read = F.col("shared_blks_hit"), F.col("shared_blks_read")
    d = statements.filter(read + hit > min_blocks)
    return topn(d, limit, [F.desc_nulls_first("shared_blks_read"), F.asc("queryid")], keys).select(
        *keys,
        "queryid",
        "query",
        "calls",
        "shared_blks_read",
        "shared_blks_hit",
        (read / (hit + read) * 100).alias("read_percentage"),
    )


# --- tables -------------------------------------------------------------------------------------

TABLE_ORDERS = {
    # Ordered by bytes, not by the size text.
    "size": F.desc_nulls_first,
    "rows": F.desc_nulls_first,
    "dead_tuples": F.desc_nulls_first,
    "seq_scans": F.desc_nulls_first,
    "last_vacuum": F.desc_nulls_last,
}
TABLE_ORDER_COLUMNS = {
    "size": "total_size_bytes",
    "rows": "n_live_tup",
    "dead_tuples": "n_dead_tup",
    "seq_scans": "seq_scan",
    "last_vacuum": "last_vacuum",
}


def table_order(order_by: str = "size") -> list[Column]:
    """Sort columns of the table report."""
    order_by = order_by if order_by in TABLE_ORDERS else "size"
    return [TABLE_ORDERS[order_by](TABLE_ORDER_COLUMNS[order_by]), F.asc("schema_name"), F.asc("table_name")]


def table_report(
    tables: DataFrame, schema: str = "public", table: str | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    d = tables.filter((F.col("relkind") == "r") & (F.col("schemaname") == schema) & not_system_schema("schemaname"))
    if table:
        d = d.filter(F.col("relname").ilike(table))
    idx = F.coalesce("idx_scan", F.lit(0).cast("long"))
    return d.select(
        *keys,
        F.col("relname").alias("table_name"),
        F.col("schemaname").alias("schema_name"),
        size_pretty("table_size_bytes").alias("table_size"),
        size_pretty("indexes_size_bytes").alias("indexes_size"),
        size_pretty("total_size_bytes").alias("total_size"),
        "total_size_bytes",
        "n_live_tup",
        "n_dead_tup",
        pct_ratio("n_dead_tup", "n_live_tup").alias("dead_tuple_ratio"),
        "seq_scan",
        "seq_tup_read",
        "idx_scan",
        "idx_tup_fetch",
        pct_ratio(idx, F.col("seq_scan") + idx).alias("index_scan_ratio"),
        "last_vacuum",
        "last_autovacuum",
        "last_analyze",
        "last_autoanalyze",
        "vacuum_count",
        "autovacuum_count",
        "analyze_count",
        "autoanalyze_count",
    )


def table_index_report(
    indexes: DataFrame, schema: str = "public", table: str | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Index rows of the named table (exact name), or of all tables of the schema."""
    d = indexes.filter(F.col("schemaname") == schema)
    if table:
        d = d.filter(F.col("relname") == table)
    return d.select(
        *keys,
        F.col("relname").alias("table_name"),
        "index_name",
        F.col("idx_scan").alias("scans"),
        F.col("idx_tup_read").alias("tuples_read"),
        F.col("idx_tup_fetch").alias("tuples_fetched"),
        size_pretty("size_bytes").alias("size"),
        "size_bytes",
        "definition",
    )


def table_findings(report: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One finding per table and rule."""
    live = F.coalesce("n_live_tup", F.lit(0))
    seq = F.coalesce("seq_scan", F.lit(0))
    dead, idx = F.col("dead_tuple_ratio"), F.col("index_scan_ratio")
    name = F.col("table_name")
    never = F.coalesce("last_analyze", "last_autoanalyze").isNull()
    return findings(
        report,
        "table_stats",
        [
            Rule("needs_vacuum", dead > 10, "warning", name, dead, text(name, ": dead rows at ", fixed_text(dead, 2), "%")),
            Rule("needs_analyze", (live > 1000) & never, "warning", name, live, text(name, ": never analyzed")),
            Rule(
                "low_index_usage",
                (seq > 100) & (idx < 50) & (live > 10000),
                "warning",
                name,
                idx,
                text(name, ": index scans at ", fixed_text(idx, 2), "%"),
            ),
        ],
        keys,
    )


def table_advice(report: DataFrame, order_by: str = "size", keys: Sequence[str] = KEYS) -> DataFrame:
    """The findings rolled up per key: counts and the first few names in report order."""
    order = table_order(order_by)
    live = F.coalesce("n_live_tup", F.lit(0))
    seq = F.coalesce("seq_scan", F.lit(0))
    never = F.coalesce("last_analyze", "last_autoanalyze").isNull()
    groups = [
        ("needs_vacuum", F.col("dead_tuple_ratio") > 10, 5),
        ("needs_analyze", (live > 1000) & never, 5),
        ("low_index_usage", (seq > 100) & (F.col("index_scan_ratio") < 50) & (live > 10000), 3),
    ]
    out = None
    for rule, when, n in groups:
        part = first_names(report.filter(when), "table_name", order, keys, n).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out.select(*keys, "rule", F.col("n").alias("tables"), F.col("names").alias("first_tables"))


def table_stats(
    tables: DataFrame,
    indexes: DataFrame | None = None,
    schema: str = "public",
    table: str | None = None,
    include_indexes: bool = True,
    order_by: str = "size",
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    report = table_report(tables, schema, table, keys)
    out = {
        "tables": report,
        "summary": report.groupBy(*keys).agg(F.count(F.lit(1)).alias("table_count")),
        "findings": table_findings(report, keys),
        "advice": table_advice(report, order_by, keys),
    }
    if include_indexes and table and indexes is not None:
        out["indexes"] = table_index_report(indexes, schema, table, keys)
    return out


def io_hotspots(tables: DataFrame, schema: str = "public", keys: Sequence[str] = KEYS) -> DataFrame:
    cols = ("seq_scan", "idx_scan", "n_dead_tup", "n_live_tup", "n_tup_ins", "n_tup_upd", "n_tup_del")
    return tables.filter(F.col("schemaname") == schema).select(
        *keys, F.col("relname").alias("table_name"), *cols, "last_vacuum", "last_autovacuum"
    )


def relation_sizes(tables: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return tables.select(
        *keys,
        "schemaname",
        F.col("relname").alias("table_name"),
        size_pretty("table_size_bytes").alias("table_size"),
        size_pretty("indexes_size_bytes").alias("indexes_size"),
        size_pretty("total_size_bytes").alias("total_size"),
        "total_size_bytes",
    )


# --- disk I/O -----------------------------------------------------------------------------------


POOL_COUNTERS = ("heap_blks_read", "heap_blks_hit", "idx_blks_read", "idx_blks_hit")


def heap_ratio(zero_is_missing: bool = True) -> Column:
    return zero_as_missing(hit_ratio("heap_blks_hit", "heap_blks_read"), 100, zero_is_missing)


def pool_ratios(zero_is_missing: bool = True) -> tuple[Column, Column]:
    """Cache hit ratios of heap and index blocks."""
    return heap_ratio(zero_is_missing), zero_as_missing(hit_ratio("idx_blks_hit", "idx_blks_read"), 100, zero_is_missing)


def io_candidates(size: str, schema: str = "public", min_size_gb: float = 1) -> Column:
    """Whether a relation is large enough for the I/O reports."""
    return (F.col("schemaname") == schema) & not_system_schema("schemaname") & (F.col(size) >= gb_to_bytes(min_size_gb))


def physical_reads() -> Column:
    return F.col("heap_blks_read") + F.coalesce("idx_blks_read", F.lit(0).cast("long"))


def scan_ratio() -> Column:
    """Share of sequential scans in all scans of a table."""
    return pct_ratio("seq_scan", F.col("seq_scan") + F.coalesce("idx_scan", F.lit(0).cast("long")))


@counter_operator(["schemaname", "relname"], TABLE_COUNTERS)
def buffer_pool_io(tables: DataFrame, zero_is_missing: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    names = {
        "heap_blks_read": "heap_blocks_read",
        "heap_blks_hit": "heap_blocks_hit",
        "idx_blks_read": "index_blocks_read",
        "idx_blks_hit": "index_blocks_hit",
        "toast_blks_read": "toast_blocks_read",
        "toast_blks_hit": "toast_blocks_hit",
    }
    sums = tables.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    zero = F.lit(0).cast("long")
    return sums.select(
        *keys,
        *[F.coalesce(c, zero).alias(name) for c, name in names.items()],
        zero_as_missing(hit_ratio("heap_blks_hit", "heap_blks_read"), 100, zero_is_missing).alias("heap_hit_ratio"),
        zero_as_missing(hit_ratio("idx_blks_hit", "idx_blks_read"), 100, zero_is_missing).alias("index_hit_ratio"),
    )


@counter_operator(["schemaname", "relname"], TABLE_COUNTERS)
def table_io(
    tables: DataFrame,
    schema: str = "public",
    top_n: int = 20,
    min_size_gb: float = 1,
    zero_is_missing: bool = True,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Tables with most physical reads; scan figures only for those also among the most scanned."""
    keys = list(keys)
    zero = F.lit(0).cast("long")
    big = tables.filter(
        (F.col("schemaname") == schema)
        & not_system_schema("schemaname")
        & (F.col("total_size_bytes") >= gb_to_bytes(min_size_gb))
    )
    idx_read, idx_hit = F.coalesce("idx_blks_read", zero), F.coalesce("idx_blks_hit", zero)
    by_reads = topn(
        big.withColumn("total_reads", F.col("heap_blks_read") + idx_read),
        top_n,
        [F.desc_nulls_first("total_reads"), F.asc("relname")],
        keys,
    ).select(
        *keys,
        F.col("relname").alias("table_name"),
        F.coalesce("heap_blks_read", zero).alias("heap_blocks_read"),
        F.coalesce("heap_blks_hit", zero).alias("heap_blocks_hit"),
        zero_as_missing(hit_ratio("heap_blks_hit", "heap_blks_read"), 100, zero_is_missing).alias("heap_hit_ratio"),
        idx_read.alias("index_blocks_read"),
        idx_hit.alias("index_blocks_hit"),
        zero_as_missing(hit_ratio("idx_blks_hit", "idx_blks_read"), 100, zero_is_missing).alias("index_hit_ratio"),
        F.coalesce("total_reads", zero).alias("total_physical_reads"),
    )
    scans = F.col("seq_scan") + F.coalesce("idx_scan", zero)
    by_scans = topn(big, top_n, [F.desc_nulls_first("seq_tup_read"), F.asc("relname")], keys).select(
        *keys,
        F.col("relname").alias("table_name"),
        F.col("seq_scan").alias("seq_scans"),
        F.col("seq_tup_read").alias("seq_tuples_read"),
        F.col("idx_scan").alias("idx_scans"),
        F.col("idx_tup_fetch").alias("idx_tuples_fetched"),
        pct_ratio("seq_scan", scans).alias("seq_scan_ratio"),
        F.col("n_live_tup").alias("live_tuples"),
    )
    filled = ("seq_scans", "seq_tuples_read", "idx_scans", "idx_tuples_fetched", "live_tuples")
    return by_reads.join(by_scans, [*keys, "table_name"], "left").withColumns(
        {c: F.coalesce(c, zero) for c in filled} | {"seq_scan_ratio": F.coalesce("seq_scan_ratio", F.lit(0.0))}
    )


@counter_operator(["schemaname", "relname", "index_name"], ["idx_scan", "idx_blks_read", "idx_blks_hit"])
def index_io(
    indexes: DataFrame,
    schema: str = "public",
    top_n: int = 20,
    min_size_gb: float = 1,
    zero_is_missing: bool = True,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    zero = F.lit(0).cast("long")
    big = indexes.filter(
        (F.col("schemaname") == schema)
        & not_system_schema("schemaname")
        & (F.col("size_bytes") >= gb_to_bytes(min_size_gb))
    )
    return topn(big, top_n, [F.desc_nulls_first("idx_blks_read"), F.asc("index_name")], keys).select(
        *keys,
        "index_name",
        F.col("relname").alias("table_name"),
        F.coalesce("idx_blks_read", zero).alias("blocks_read"),
        F.coalesce("idx_blks_hit", zero).alias("blocks_hit"),
        zero_as_missing(hit_ratio("idx_blks_hit", "idx_blks_read"), 100, zero_is_missing).alias("hit_ratio"),
    )


def buffer_pool_findings(pool: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    heap, idx = F.col("heap_hit_ratio"), F.col("index_hit_ratio")
    whole = F.lit("buffer_pool")
    low_heap, low_idx = heap < 90, idx < 95
    return findings(
        pool,
        "disk_io",
        [
            Rule("heap_hit_low", low_heap, "warning", whole, heap, text("heap cache hit ratio ", fixed_text(heap, 2), "%")),
            Rule("heap_hit_advice", low_heap, "advice", whole, heap, text("raise shared_buffers")),
            Rule("index_hit_low", low_idx, "warning", whole, idx, text("index cache hit ratio ", fixed_text(idx, 2), "%")),
            Rule("index_hit_advice", low_idx, "advice", whole, idx, text("keep hot indexes in cache")),
        ],
        keys,
    )


def table_io_findings(report: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    name, reads, heap = F.col("table_name"), F.col("total_physical_reads"), F.col("heap_hit_ratio")
    seq, live = F.col("seq_scan_ratio"), F.col("live_tuples")
    scanned = (seq > 80) & (live > 10000)
    return findings(
        report,
        "disk_io",
        [
            Rule(
                "table_reads",
                (reads > 1000) & (heap < 85),
                "warning",
                name,
                heap,
                text("table ", name, ": ", reads, " reads at ", fixed_text(heap, 2), "% cache hits"),
            ),
            Rule(
                "sequential_scans",
                scanned,
                "warning",
                name,
                seq,
                text("table ", name, ": ", fixed_text(seq, 2), "% sequential scans over ", live, " rows"),
            ),
            Rule("index_missing", scanned, "advice", name, seq, text("add indexes to table ", name)),
        ],
        keys,
    )


def index_io_findings(report: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    name, ratio = F.col("index_name"), F.col("hit_ratio")
    return findings(
        report,
        "disk_io",
        [
            Rule(
                "index_reads",
                (F.col("blocks_read") > 1000) & (ratio < 90),
                "warning",
                name,
                ratio,
                text("index ", name, ": cache hit ratio ", fixed_text(ratio, 2), "%"),
            )
        ],
        keys,
    )


def disk_io_analysis(
    tables: DataFrame,
    indexes: DataFrame | None = None,
    schema: str = "public",
    include_indexes: bool = True,
    top_n: int = 20,
    analysis_type: str = "all",
    min_size_gb: float = 1,
    mode: str = "cumulative",
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    """The chosen I/O reports, their findings (each message once per key) and a summary."""
    keys = list(keys)
    out: dict[str, DataFrame] = {}
    notes: list[DataFrame] = []
    if analysis_type in ("all", "buffer_pool"):
        out["buffer_pool"] = buffer_pool_io(tables, keys=keys, mode=mode)
        notes.append(buffer_pool_findings(out["buffer_pool"], keys))
    if analysis_type in ("all", "tables"):
        out["tables"] = table_io(tables, schema, top_n, min_size_gb, keys=keys, mode=mode)
        notes.append(table_io_findings(out["tables"], keys))
    if analysis_type in ("all", "indexes") and include_indexes and indexes is not None:
        out["indexes"] = index_io(indexes, schema, top_n, min_size_gb, keys=keys, mode=mode)
        notes.append(index_io_findings(out["indexes"], keys))
    if not notes:
        raise ValueError(f"nothing to analyse for analysis_type={analysis_type!r}")
    every = notes[0]
    for part in notes[1:]:
        every = every.unionByName(part)
    advice = F.col("severity") == "advice"
    # Messages name their subject, so equal messages are equal findings.
    out["findings"] = every.dropDuplicates([*keys, "severity", "message"])
    counts = out["findings"].groupBy(*keys).agg(
        F.count_if(~advice).alias("total_issues"), F.count_if(advice).alias("total_recommendations")
    )
    if "buffer_pool" in out:
        pool = out["buffer_pool"].select(
            *keys,
            F.col("heap_hit_ratio").alias("heap_cache_hit_ratio"),
            F.col("index_hit_ratio").alias("index_cache_hit_ratio"),
        )
        zero = F.lit(0).cast("long")
        counts = keyed_join(pool, counts, keys, "left").withColumns(
            {c: F.coalesce(c, zero) for c in ("total_issues", "total_recommendations")}
        )
    out["summary"] = counts
    return out
