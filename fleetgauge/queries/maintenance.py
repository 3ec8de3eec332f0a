"""Vacuum, sizes, freeze, index listing, bloat."""

from __future__ import annotations

from fleetgauge.operators import bloat as B
from fleetgauge.operators import maintenance as M
from fleetgauge.queries.health import _DEFS, index_defs
from fleetgauge.queries.registry import K, SYSTEM, age, fixed, pct, pct0, pretty, query, rule, setting, sized, top


@query(
    "m1_top_objects_by_size",
    ["t_tables", "t_indexes"],
    f"""SELECT {K}, 'table' AS type, schemaname, relname AS object_name, relpages * 8192 AS size_bytes, {pretty('(relpages * 8192)')} AS size
FROM t_tables {top(5, 'relpages DESC, schemaname, relname')}
UNION ALL SELECT * FROM (SELECT {K}, 'index' AS type, schemaname, index_name AS object_name, relpages * 8192 AS size_bytes, {pretty('(relpages * 8192)')} AS size
FROM t_indexes {top(5, 'relpages DESC, schemaname, index_name')})""",
)
def _(t):
    return M.top_objects_by_size(t["t_tables"], t["t_indexes"])


@query(
    "m2_stale_statistics",
    ["t_tables"],
    f"""SELECT {K}, schemaname, relname, n_live_tup, last_autoanalyze, {pct('n_mod_since_analyze', 'greatest(n_live_tup, 1)')} AS modified_percent
FROM t_tables WHERE n_live_tup > 1000 AND n_mod_since_analyze * 10 > n_live_tup {top(10, 'modified_percent DESC, schemaname, relname')}""",
)
def _(t):
    return M.stale_statistics(t["t_tables"])


@query(
    "m3_database_sizes",
    ["t_databases"],
    f"SELECT {K}, datname, size_bytes, {pretty('size_bytes')} AS size FROM t_databases WHERE NOT datistemplate {top(10, 'size_bytes DESC, datname')}",
)
def _(t):
    return M.database_sizes(t["t_databases"])


@query(
    "m4_sequence_exhaustion",
    ["t_sequences"],
    f"""SELECT {K}, schemaname, sequence_name, last_val, max_val, last_val::DOUBLE * 100 / max_val::DOUBLE AS percentage_used FROM t_sequences
WHERE NOT seqcycle AND last_val * 10 > max_val * 8""",
)
def _(t):
    return M.sequence_exhaustion(t["t_sequences"])


@query(
    "m5_freeze_prediction",
    ["t_tables", "t_settings"],
    f"""SELECT {K}, table_name, schemaname, total_size, xid_remain_ages, mxid_remain_ages, freeze_status FROM (
SELECT {K}, relname AS table_name, schemaname, {pretty('total_size_bytes')} AS total_size, xm - xid_age AS xid_remain_ages, CASE WHEN NOT na THEN mm - mxid_age END AS mxid_remain_ages,
  CASE WHEN xm - xid_age < 0 THEN 'XID_OVERDUE' WHEN na THEN 'MXID_NA' WHEN mm - mxid_age < 0 THEN 'MXID_OVERDUE'
    WHEN least(xm - xid_age, mm - mxid_age) * 10 < xm THEN 'CRITICAL' WHEN least(xm - xid_age, mm - mxid_age) * 4 < xm THEN 'WARNING' ELSE 'OK' END AS freeze_status,
  least(xm - xid_age, CASE WHEN na THEN 2147483647 ELSE mm - mxid_age END) AS near
FROM (SELECT r.*, {setting('autovacuum_freeze_max_age', 'BIGINT')} AS xm, {setting('autovacuum_multixact_freeze_max_age', 'BIGINT')} AS mm,
  relminmxid = 0 OR mxid_age = 2147483647 AS na FROM t_tables r WHERE relkind IN ('r', 'm') AND schemaname NOT IN {SYSTEM})
WHERE (xm - xid_age) * 4 < xm OR (NOT na AND (mm - mxid_age) * 4 < mm)) {top(10, 'freeze_status, near, schemaname, table_name')}""",
)
def _(t):
    return M.freeze_prediction(t["t_tables"], t["t_settings"])


def _autovacuum(t) -> dict:
    return M.autovacuum_status(t["t_settings"], t["t_activity"])


@query("m6_autovacuum_settings", ["t_settings"], f"SELECT {K}, name, setting, unit FROM t_settings WHERE name LIKE 'autovacuum%'")
def _(t):
    return _autovacuum(t)["settings"]


@query(
    "m6_autovacuum_workers",
    ["t_activity"],
    f"""SELECT {K}, pid, datname AS database, CASE WHEN query LIKE '%autovacuum: %' THEN regexp_extract(query, 'autovacuum: (.*)', 1) END AS operation, state,
  {age('snapshot_ts', 'xact_start')} AS duration_seconds, wait_event_type, wait_event FROM t_activity WHERE backend_type = 'autovacuum worker'""",
)
def _(t):
    return _autovacuum(t)["active_workers"]


@query(
    "m6_autovacuum_launcher",
    ["t_activity"],
    f"""SELECT {K}, pid, state, {age('snapshot_ts', 'backend_start')} AS uptime_seconds FROM t_activity WHERE backend_type = 'autovacuum launcher' {top(1, 'pid')}""",
)
def _(t):
    return _autovacuum(t)["launcher"]


_AV = f"""SELECT *, max_workers - active_worker_count AS workers_available FROM (
  SELECT {K}, coalesce({setting('autovacuum')} = 'on', true) AS autovacuum_enabled, coalesce({setting('autovacuum_max_workers', 'BIGINT')}, 3) AS max_workers,
  active_worker_count, coalesce({setting('autovacuum_naptime', 'BIGINT')}, 60) AS naptime_seconds
  FROM (SELECT {K}, count(*) FILTER (WHERE backend_type = 'autovacuum worker') AS active_worker_count FROM t_activity GROUP BY {K}) r)"""


@query("m6_autovacuum_summary", ["t_settings", "t_activity"], _AV)
def _(t):
    return _autovacuum(t)["summary"]


@query(
    "m6_autovacuum_findings",
    ["t_settings", "t_activity"],
    rule(
        "autovacuum_status", "workers_busy", "warning", "'autovacuum'", "active_worker_count",
        "'no autovacuum worker is free; allow more of them'", f"FROM ({_AV}) WHERE workers_available = 0",
    ),
)
def _(t):
    return _autovacuum(t)["findings"]


@query(
    "m7_list_indexes",
    ["t_index_facts", "t_index_columns", "t_index_counters"],
    f"""SELECT d.cluster_id, d.snapshot_ts, d.schema_name, d.table_name, d.index_name, d.access_method, array_to_string(d.cols, ',') AS columns, d.is_unique, d.is_primary, d.is_valid,
  {pretty('d.size_bytes')} AS size, d.size_bytes, d.definition, coalesce(c.idx_scan, 0) AS scans, coalesce(c.idx_tup_read, 0) AS tuples_read, coalesce(c.idx_tup_fetch, 0) AS tuples_fetched
FROM {_DEFS} d LEFT JOIN t_index_counters c ON c.cluster_id = d.cluster_id AND c.snapshot_ts = d.snapshot_ts AND c.schemaname = d.schema_name AND c.relname = d.table_name
  AND c.index_name = d.index_name""",
)
def _(t):
    return M.list_indexes(index_defs(t), t["t_index_counters"])["indexes"]


@query(
    "m7_index_totals",
    ["t_index_facts", "t_index_columns"],
    f"SELECT {K}, schema_name, table_name, count(*) AS index_count, sum(size_bytes)::BIGINT AS total_index_size_bytes FROM {_DEFS} GROUP BY ALL",
)
def _(t):
    return M.list_indexes(index_defs(t))["summary"]


# --- vacuum -------------------------------------------------------------------------------------

_THRESHOLD = f"(coalesce({setting('autovacuum_vacuum_threshold', 'DOUBLE')}, 50) + coalesce({setting('autovacuum_vacuum_scale_factor', 'DOUBLE')}, 0.2::DOUBLE) * n_live_tup)"
_VT = f"relkind = 'r' AND schemaname NOT IN {SYSTEM} AND schemaname = 'public' AND relname NOT LIKE 'pg_toast%'"
_NEED_ALL = f"""SELECT {K}, schemaname AS schema_name, relname AS table_name, n_live_tup, n_dead_tup, {pct0('n_dead_tup', 'n_live_tup')} AS dead_tuple_ratio, last_vacuum, last_autovacuum,
  vacuum_count, autovacuum_count, {pretty('table_size_bytes')} AS table_size, table_size_bytes, {_THRESHOLD} AS autovacuum_threshold, n_dead_tup > {_THRESHOLD} AS exceeds_threshold
FROM t_tables r WHERE {_VT} AND n_dead_tup >= 1000"""
_NEED = f"{_NEED_ALL} {top(50, 'n_dead_tup DESC, schemaname, relname')}"
_OLD_ALL = f"""SELECT {K}, schemaname AS schema_name, relname AS table_name, xid_age, {pretty('table_size_bytes')} AS table_size, {pct('xid_age', '2147483647')} AS pct_towards_wraparound
FROM t_tables WHERE relkind = 'r' AND schemaname NOT IN {SYSTEM} AND xid_age > 100000000"""
_OLD = f"{_OLD_ALL} {top(20, 'xid_age DESC, schemaname, relname')}"
_COUNTS = f"""(SELECT {K}, sum(d)::BIGINT AS d, sum(e)::BIGINT AS e, sum(h)::BIGINT AS h, sum(w)::BIGINT AS w, sum(c)::BIGINT AS c FROM (
  SELECT {K}, 1 AS d, exceeds_threshold::INT AS e, (dead_tuple_ratio > 20)::INT AS h, 0 AS w, 0 AS c FROM ({_NEED_ALL})
  UNION ALL SELECT {K}, 0, 0, 0, 1, (pct_towards_wraparound > 50)::INT FROM ({_OLD_ALL})) GROUP BY {K})"""


def _pending(t) -> dict:
    return M.pending_vacuum(t["t_tables"], t["t_settings"])


@query("m10_tables_needing_vacuum", ["t_tables", "t_settings"], _NEED)
def _(t):
    return _pending(t)["tables_needing_vacuum"]


@query("m10_wraparound_tables", ["t_tables"], _OLD)
def _(t):
    return _pending(t)["tables_with_wraparound_risk"]


@query(
    "m10_pending_summary",
    ["t_tables", "t_settings"],
    f"SELECT {K}, d AS tables_with_dead_tuples, e AS tables_exceeding_threshold, w AS tables_with_wraparound_risk FROM {_COUNTS}",
)
def _(t):
    return _pending(t)["summary"]


@query(
    "m10_pending_findings",
    ["t_tables", "t_settings"],
    " UNION ALL ".join(
        [
            rule("pending_vacuum", "high_dead_ratio", "high", "'tables'", "h", "h || ' tables above 20% dead rows; run VACUUM'", f"FROM {_COUNTS} WHERE h > 0"),
            rule("pending_vacuum", "wraparound_half", "critical", "'tables'", "c", "c || ' tables past half of the transaction id range; run VACUUM FREEZE'", f"FROM {_COUNTS} WHERE c > 0"),
        ]
    ),
)
def _(t):
    return _pending(t)["findings"]


@query(
    "d2_autovacuum_trigger",
    ["t_tables", "t_settings"],
    f"""SELECT {K}, schemaname, relname AS table_name, n_live_tup, n_dead_tup, CAST(printf('%.0f', CAST({_THRESHOLD} AS DOUBLE)) AS DOUBLE) AS vacuum_trigger_threshold,
  CASE WHEN n_dead_tup >= {_THRESHOLD} THEN 'NEEDS VACUUM' ELSE 'OK' END AS status, last_autovacuum FROM t_tables r""",
)
def _(t):
    return M.autovacuum_trigger(t["t_tables"], t["t_settings"])


_RECENT_ALL = f"""SELECT {K}, schemaname AS schema_name, relname AS table_name, last_vacuum, last_autovacuum, last_analyze, last_autoanalyze, vacuum_count, autovacuum_count, analyze_count,
  autoanalyze_count, n_live_tup, n_dead_tup, n_mod_since_analyze, {pretty('table_size_bytes')} AS table_size, lv AS last_vacuumed,
  CASE WHEN lv IS NULL THEN 'never' WHEN lv < snapshot_ts - INTERVAL 7 DAY THEN 'stale' WHEN lv < snapshot_ts - INTERVAL 1 DAY THEN 'recent' ELSE 'fresh' END AS vacuum_status
FROM (SELECT *, greatest(last_vacuum, last_autovacuum) AS lv FROM t_tables WHERE {_VT})"""
_RECENT = f"{_RECENT_ALL} {top(50, 'lv DESC NULLS LAST, schemaname, relname')}"


def _history(t) -> dict:
    return M.vacuum_history(t["t_tables"])


@query("m11_vacuum_history", ["t_tables"], _RECENT)
def _(t):
    return _history(t)["recent_activity"]


@query(
    "m11_vacuum_summary",
    ["t_tables"],
    f"""SELECT {K}, count(*) AS total_tables, count(*) FILTER (WHERE vacuum_status = 'never') AS never_vacuumed, count(*) FILTER (WHERE vacuum_status = 'stale') AS stale_vacuum,
  count(*) FILTER (WHERE vacuum_status = 'recent') AS recent_vacuum, count(*) FILTER (WHERE vacuum_status = 'fresh') AS fresh_vacuum FROM ({_RECENT_ALL}) GROUP BY {K}""",
)
def _(t):
    return _history(t)["summary"]


def _names(name: str, order: str, n: int = 5) -> str:
    return f"array_to_string((list({name} ORDER BY {order}))[1:{n}], ', ')"


_VAC_ORDER = "last_vacuumed DESC NULLS LAST, schema_name, table_name"


@query(
    "m11_vacuum_findings",
    ["t_tables"],
    " UNION ALL ".join(
        rule("vacuum_history", band, severity, _names("table_name", _VAC_ORDER), "count(*)", f"count(*) || '{what}'", f"FROM ({_RECENT_ALL}) WHERE vacuum_status = '{band}' GROUP BY {K}")
        for band, severity, what in (("never", "warning", " tables without any vacuum so far"), ("stale", "info", " tables not vacuumed for over 7 days"))
    ),
)
def _(t):
    return _history(t)["findings"]


_AVG = "CAST(round(sum(avail) / count(*)::DOUBLE) AS BIGINT)"


@query(
    "d1_free_space_by_table",
    ["t_page_free_space"],
    f"""SELECT cluster_id, relname, n AS pages, {pretty('a')} AS avg_free_space, {pct('s', 'n * 8192')} AS avg_free_percent FROM (
  SELECT cluster_id, relname, count(*) AS n, sum(avail)::BIGINT AS s, {_AVG} AS a FROM t_page_free_space GROUP BY ALL)""",
)
def _(t):
    return M.free_space_by_table(t["t_page_free_space"], keys=["cluster_id"])


# --- bloat --------------------------------------------------------------------------------------


def _metrics(approx: bool, where: str) -> str:
    p = "approx_" if approx else ""
    extra = "scanned_percent, " if approx else ""
    kind = "approximate" if approx else "exact"
    return f"""(SELECT *, {sized('table_len_bytes')} AS table_len_pretty, {sized('free_space_bytes')} AS free_space_pretty, {sized('wasted_space_bytes')} AS wasted_space_pretty,
  CASE WHEN table_len_bytes > 0 THEN CAST(printf('%.2f', CAST(100.0::DOUBLE * wasted_space_bytes / table_len_bytes AS DOUBLE)) AS DOUBLE) ELSE 0 END AS wasted_percent,
  CASE WHEN pts >= 6 THEN 'critical' WHEN pts >= 4 THEN 'high' WHEN pts >= 2 THEN 'moderate' WHEN pts >= 1 THEN 'low' ELSE 'minimal' END AS bloat_severity,
  CASE WHEN dead_tuple_percent > 30 THEN 'critical' WHEN dead_tuple_percent > 10 THEN 'warning' ELSE 'normal' END AS dead_tuple_status,
  CASE WHEN free_percent > 30 THEN 'critical' WHEN free_percent > 20 THEN 'warning' ELSE 'normal' END AS free_space_status,
  CASE WHEN tuple_percent < 50 THEN 'critical' WHEN tuple_percent < 70 THEN 'warning' ELSE 'normal' END AS tuple_density_status
FROM (SELECT *, CASE WHEN dead_tuple_percent > 30 THEN 3 WHEN dead_tuple_percent > 10 THEN 2 ELSE 0 END + CASE WHEN free_percent > 30 THEN 3 WHEN free_percent > 20 THEN 2 ELSE 0 END
  + CASE WHEN tuple_percent < 50 THEN 3 WHEN tuple_percent < 70 THEN 2 ELSE 0 END AS pts, dead_tuple_len + free_space_bytes AS wasted_space_bytes FROM (
  SELECT {K}, schemaname AS schema_name, relname AS table_name, '{kind}' AS analysis_type, {extra}table_len AS table_len_bytes, {p}tuple_count AS live_tuple_count, {p}tuple_len AS live_tuple_len,
    {p}tuple_percent AS tuple_percent, dead_tuple_count, dead_tuple_len, dead_tuple_percent, {p}free_space AS free_space_bytes, {p}free_percent AS free_percent
  FROM t_heap_samples WHERE {where})))"""


_ALL_EXACT = _metrics(False, "true")
_ALL_APPROX = _metrics(True, "true")
_PUBLIC = _metrics(False, "schemaname = 'public' AND table_len >= 1073741")


@query("m8a_bloat_metrics", ["t_heap_samples"], f"SELECT * EXCLUDE (pts) FROM {_ALL_EXACT}")
def _(t):
    return B.bloat_metrics(t["t_heap_samples"])


@query("m8a_bloat_metrics_approx", ["t_heap_samples"], f"SELECT * EXCLUDE (pts) FROM {_ALL_APPROX}")
def _(t):
    return B.bloat_metrics(t["t_heap_samples"], use_approx=True)


@query(
    "m8b_table_bloat_severity",
    ["t_heap_samples"],
    f"SELECT {K}, bloat_severity, dead_tuple_status, free_space_status, tuple_density_status, count(*) AS n FROM {_ALL_EXACT} GROUP BY ALL",
)
def _(t):
    statuses = ["bloat_severity", "dead_tuple_status", "free_space_status", "tuple_density_status"]
    return B.bloat_metrics(t["t_heap_samples"]).groupBy(*K.split(", "), *statuses).count().withColumnRenamed("count", "n")


_D, _FR, _TP = "dead_tuple_percent", "free_percent", "tuple_percent"
_NM = "schema_name || '.' || table_name"


def _note(name: str, when: str, severity: str, metric: str, message: str) -> str:
    return rule("table_bloat", name, severity, _NM, metric, message, f"FROM m WHERE {when}")


_CLEAN = f"NOT ({_D} > 10 OR {_FR} > 20 OR ({_TP} > 0 AND {_TP} < 70))"
_SOUND = f"({_D} < 10 AND {_FR} <= 20 AND {_TP} >= 70)"
_TABLE_NOTES = " UNION ALL ".join(
    [
        _note("dead_critical", f"{_D} > 30", "critical", _D, f"'dead rows ' || {fixed(_D, 1)} || '%: VACUUM ANALYZE ' || {_NM}"),
        _note("dead_tuning", f"{_D} > 30", "advice", _D, f"'lower autovacuum_vacuum_scale_factor of ' || {_NM}"),
        _note("dead_warning", f"{_D} > 10 AND {_D} <= 30", "warning", _D, f"'dead rows ' || {fixed(_D, 1)} || '%: tune ' || {_NM}"),
        _note("free_critical", f"{_FR} > 30", "critical", _FR, f"'free space ' || {fixed(_FR, 1)} || '%: rewrite ' || {_NM}"),
        _note("free_warning", f"{_FR} > 20 AND {_FR} <= 30", "warning", _FR, f"'free space ' || {fixed(_FR, 1)} || '%: plan a rewrite of ' || {_NM}"),
        _note("density_critical", f"{_TP} > 0 AND {_TP} < 50", "critical", _TP, f"'live data ' || {fixed(_TP, 1)} || '%: VACUUM FULL ' || {_NM}"),
        _note("density_warning", f"{_TP} >= 50 AND {_TP} < 70", "warning", _TP, f"'live data ' || {fixed(_TP, 1)} || '%: heavy bloat in ' || {_NM}"),
        _note("healthy", f"{_CLEAN} AND {_SOUND}", "ok", _TP, f"{_NM} || ' is healthy'"),
        _note("minimal", f"{_CLEAN} AND NOT {_SOUND}", "ok", _TP, f"{_NM} || ' has minimal bloat'"),
    ]
)


@query("m8c_table_bloat_findings", ["t_heap_samples"], f"SELECT * FROM (WITH m AS {_ALL_EXACT} {_TABLE_NOTES})")
def _(t):
    return B.table_bloat_findings(B.bloat_metrics(t["t_heap_samples"]))


def _bloat(t) -> dict:
    # 0.001 GB, so that the test tables pass the size filter.
    return B.table_bloat(t["t_heap_samples"], min_table_size_gb=0.001)


_SHOWN = f"(SELECT * FROM {_PUBLIC} WHERE wasted_percent >= 20)"


@query("m8_table_bloat", ["t_heap_samples"], f"SELECT * EXCLUDE (pts) FROM {_SHOWN}")
def _(t):
    return _bloat(t)["tables"]


@query(
    "m8_table_bloat_summary",
    ["t_heap_samples"],
    f"""SELECT {K}, n AS tables_analyzed, s AS total_table_size, {sized('s')} AS total_table_size_pretty, w AS total_wasted_space, {sized('w')} AS total_wasted_space_pretty,
  CASE WHEN s > 0 THEN CAST(printf('%.2f', CAST(100.0::DOUBLE * w / s AS DOUBLE)) AS DOUBLE) ELSE 0 END AS overall_wasted_percent FROM (
  SELECT {K}, count(*) FILTER (WHERE wasted_percent >= 20) AS n, sum(table_len_bytes)::BIGINT AS s, sum(wasted_space_bytes)::BIGINT AS w FROM {_PUBLIC} GROUP BY {K})""",
)
def _(t):
    return _bloat(t)["summary"]


def _rolled(source: str, name: str, severity: str, when: str, what: str, item: str, order: str) -> str:
    return rule(source, name, severity, _names(item, order), "count(*)", f"count(*) || '{what}'", f"FROM m WHERE {when} GROUP BY {K}")


_WO = "wasted_space_bytes DESC, table_name"


@query(
    "m8c_bloat_rollup",
    ["t_heap_samples"],
    f"SELECT * FROM (WITH m AS {_SHOWN} " + " UNION ALL ".join(
        _rolled("table_bloat", name, severity, when, what, "table_name", _WO)
        for name, severity, when, what in (
            ("critical_tables", "critical", "bloat_severity = 'critical'", " tables with critical bloat"),
            ("high_tables", "high", "bloat_severity = 'high'", " tables with high bloat"),
            ("dead_over_10", "warning", f"{_D} > 10", " tables above 10% dead rows"),
            ("free_over_20", "warning", f"{_FR} > 20", " tables above 20% free space"),
            ("density_under_70", "warning", f"{_TP} > 0 AND {_TP} < 70", " tables below 70% live data"),
        )
    ) + ")",
)
def _(t):
    return _bloat(t)["findings"]


@query(
    "m8d_toast_bloat",
    ["t_heap_samples", "t_toast"],
    f"""SELECT t.cluster_id, t.snapshot_ts, t.schemaname AS schema_name, t.relname AS table_name, t.toast_relname AS toast_table_name, t.toast_size_bytes AS toast_size,
  {sized('t.toast_size_bytes')} AS toast_size_pretty, s.table_len, s.tuple_percent, s.dead_tuple_percent, s.free_percent
FROM t_toast t JOIN t_heap_samples s ON s.cluster_id = t.cluster_id AND s.snapshot_ts = t.snapshot_ts AND s.schemaname = 'pg_toast' AND s.relname = t.toast_relname""",
)
def _(t):
    return B.toast_bloat(t["t_heap_samples"], t["t_toast"])


# --- index bloat --------------------------------------------------------------------------------


def _btree(source: str) -> str:
    return f"""(SELECT *, CASE WHEN pts >= 4 OR 90 - avg_leaf_density >= 40 THEN 'critical' WHEN pts >= 3 OR 90 - avg_leaf_density >= 30 THEN 'high'
    WHEN pts >= 2 OR 90 - avg_leaf_density >= 20 THEN 'moderate' ELSE 'low' END AS bloat_severity, CAST(printf('%.2f', CAST(greatest(0.0::DOUBLE, 90 - avg_leaf_density) AS DOUBLE)) AS DOUBLE) AS estimated_bloat_percent,
  CASE WHEN avg_leaf_density < 50 THEN 'critical' WHEN avg_leaf_density < 70 THEN 'warning' ELSE 'normal' END AS density_status
FROM (SELECT *, CASE WHEN avg_leaf_density < 50 THEN 3 WHEN avg_leaf_density < 70 THEN 2 ELSE 0 END + CASE WHEN free_percent > 30 THEN 2 WHEN free_percent > 20 THEN 1 ELSE 0 END AS pts
FROM (SELECT {K}, schemaname AS schema_name, relname AS table_name, index_name, access_method AS index_type, size_bytes AS index_size, leaf_pages, empty_pages, deleted_pages,
  coalesce(nullif(avg_leaf_density::DOUBLE, 0), 90::DOUBLE) AS avg_leaf_density, leaf_fragmentation, CAST(printf('%.2f', CAST(100.0::DOUBLE * (empty_pages + deleted_pages) / leaf_pages AS DOUBLE)) AS DOUBLE) AS free_percent
FROM {source} WHERE access_method = 'btree')))"""


_BT = _btree("t_index_samples")


@query("m9a_btree_stats", ["t_index_samples"], f"SELECT * EXCLUDE (pts) FROM {_BT}")
def _(t):
    return B.btree_stats(t["t_index_samples"])


_ID = f"{K}, schemaname AS schema_name, relname AS table_name, index_name, size_bytes AS index_size"


@query("m9b_gin_stats", ["t_index_samples"], f"SELECT {_ID}, pending_pages, pending_tuples FROM t_index_samples WHERE access_method = 'gin'")
def _(t):
    return B.gin_stats(t["t_index_samples"])


@query(
    "m9b_hash_stats",
    ["t_index_samples"],
    f"""SELECT {_ID}, bucket_pages, overflow_pages, bitmap_pages, unused_pages, live_items, dead_items, hash_free_percent FROM t_index_samples
WHERE access_method = 'hash'""",
)
def _(t):
    return B.hash_stats(t["t_index_samples"])


@query(
    "m9c_index_bloat_severity",
    ["t_index_samples"],
    f"SELECT {K}, bloat_severity, density_status, count(*) AS n FROM {_BT} GROUP BY ALL",
)
def _(t):
    d = B.btree_stats(t["t_index_samples"])
    return d.groupBy(*K.split(", "), "bloat_severity", "density_status").count().withColumnRenamed("count", "n")


_INM = "schemaname || '.' || index_name"
_BNM = "schema_name || '.' || index_name"


def _inote(name: str, frm: str, when: str, severity: str, subject: str, metric: str, message: str) -> str:
    return rule("index_bloat", name, severity, subject, metric, message, f"FROM {frm} WHERE {when}")


_LD, _IF, _LF, _DP = "avg_leaf_density", "free_percent", "leaf_fragmentation", "deleted_pages"


@query(
    "m9d_index_bloat_findings",
    ["t_index_samples"],
    f"SELECT * FROM (WITH b AS {_BT} " + " UNION ALL ".join(
        [
            _inote("density_critical", "b", f"{_LD} < 50", "critical", _BNM, _LD, f"'leaf density ' || {fixed(_LD, 1)} || '%: reindex ' || {_BNM}"),
            _inote("density_warning", "b", f"{_LD} >= 50 AND {_LD} < 70", "warning", _BNM, _LD, f"'leaf density ' || {fixed(_LD, 1)} || '%: watch ' || {_BNM}"),
            _inote("free_critical", "b", f"{_IF} > 30", "critical", _BNM, _IF, f"'free pages ' || {fixed(_IF, 1)} || '%: reindex ' || {_BNM}"),
            _inote("free_warning", "b", f"{_IF} > 20 AND {_IF} <= 30", "warning", _BNM, _IF, f"'free pages ' || {fixed(_IF, 1)} || '%: watch ' || {_BNM}"),
            _inote("fragmentation", "b", f"{_LF} > 30", "warning", _BNM, _LF, f"'leaf fragmentation ' || {fixed(_LF, 1)} || '%'"),
            _inote("deleted_pages", "b", f"{_DP} > 10", "info", _BNM, _DP, f"{_DP} || ' deleted pages'"),
            _inote("healthy", "b", f"{_LD} >= 70 AND {_IF} <= 20 AND {_LF} <= 30 AND {_DP} <= 10", "ok", _BNM, _LD, f"{_BNM} || ' is healthy'"),
            _inote("pending_high", "t_index_samples", "access_method = 'gin' AND pending_tuples > 1000", "warning", _INM, "pending_tuples", "pending_tuples || ' pending tuples: run VACUUM'"),
            _inote("pending", "t_index_samples", "access_method = 'gin' AND pending_tuples > 100 AND pending_tuples <= 1000", "info", _INM, "pending_tuples", "pending_tuples || ' pending tuples'"),
            _inote("dead_items", "t_index_samples", "access_method = 'hash' AND dead_items > 100", "warning", _INM, "dead_items", "dead_items || ' dead items: run VACUUM'"),
        ]
    ) + ")",
)
def _(t):
    return B.index_bloat_findings(B.index_stats(t["t_index_samples"]))


_BTREES = "SELECT * FROM t_index_samples WHERE schemaname = 'public' AND access_method = 'btree' AND size_bytes >= 1073741"
_LARGEST = f"({_BTREES} {top(50, 'size_bytes DESC, index_name')})"
_LB = _btree(_LARGEST)
_LB_ALL = _btree(f"({_BTREES})")
_BLOATED = "CAST(trunc(index_size * estimated_bloat_percent / 100) AS BIGINT)"


def _index_bloat(t) -> dict:
    return B.index_bloat(t["t_index_samples"], min_index_size_gb=0.001)


@query(
    "m9_index_bloat",
    ["t_index_samples"],
    f"""SELECT {K}, index_name, table_name, index_size, {sized('index_size')} AS index_size_pretty, avg_leaf_density, leaf_fragmentation, estimated_bloat_percent, bloat_severity,
  {sized(_BLOATED)} AS estimated_wasted_space FROM {_LB} WHERE estimated_bloat_percent >= 20""",
)
def _(t):
    return _index_bloat(t)["indexes"]


@query(
    "m9_index_bloat_summary",
    ["t_index_samples"],
    f"""SELECT {K}, n AS indexes_analyzed, b AS indexes_with_bloat, {sized('s')} AS total_index_size, {sized('w')} AS estimated_bloated_space FROM (
  SELECT {K}, count(*) AS n, count(*) FILTER (WHERE estimated_bloat_percent >= 20) AS b, sum(index_size)::BIGINT AS s,
    coalesce(sum({_BLOATED}) FILTER (WHERE estimated_bloat_percent >= 20), 0)::BIGINT AS w FROM {_LB_ALL} GROUP BY {K})""",
)
def _(t):
    return _index_bloat(t)["summary"]


_IO = "estimated_bloat_percent DESC, index_size DESC, index_name"


@query(
    "m9d_index_bloat_rollup",
    ["t_index_samples"],
    f"SELECT * FROM (WITH m AS (SELECT * FROM {_LB_ALL} WHERE estimated_bloat_percent >= 20) " + " UNION ALL ".join(
        _rolled("index_bloat", name, severity, when, what, "index_name", _IO)
        for name, severity, when, what in (
            ("critical_indexes", "critical", "bloat_severity = 'critical'", " indexes with critical bloat"),
            ("high_indexes", "high", "bloat_severity = 'high'", " indexes with high bloat"),
            ("density_under_70", "warning", "avg_leaf_density < 70", " indexes below 70% leaf density"),
        )
    ) + ")",
)
def _(t):
    return _index_bloat(t)["findings"]


# --- single objects -----------------------------------------------------------------------------

_ONE_TABLE = "Brand_11_large"
_ONE_SAMPLE = _metrics(False, f"schemaname = 'public' AND relname = '{_ONE_TABLE}'")


def _one_table(t, **options) -> dict:
    return B.table_bloat(t["t_heap_samples"], t["t_toast"], table=_ONE_TABLE, include_toast=True, **options)


@query("m8_one_table_bloat", ["t_heap_samples"], f"SELECT * EXCLUDE (pts) FROM {_ONE_SAMPLE}")
def _(t):
    return _one_table(t)["tables"]


@query(
    "m8_one_table_toast",
    ["t_heap_samples", "t_toast"],
    f"""SELECT t.cluster_id, t.snapshot_ts, t.schemaname AS schema_name, t.relname AS table_name, t.toast_relname AS toast_table_name, t.toast_size_bytes AS toast_size,
  {sized('t.toast_size_bytes')} AS toast_size_pretty, s.table_len, s.tuple_percent, s.dead_tuple_percent, s.free_percent
FROM t_toast t JOIN t_heap_samples s ON s.cluster_id = t.cluster_id AND s.snapshot_ts = t.snapshot_ts AND s.schemaname = 'pg_toast' AND s.relname = t.toast_relname
WHERE t.schemaname = 'public' AND t.relname = '{_ONE_TABLE}'""",
)
def _(t):
    return _one_table(t)["toast"]


_BTREE_COLUMNS = ("index_name", "table_name", "index_size", "avg_leaf_density", "estimated_bloat_percent", "bloat_severity")
_ONE_BTREE = f"SELECT {K}, {', '.join(_BTREE_COLUMNS)} FROM {_BT} WHERE schema_name = 'public'"


@query("m9_one_index_bloat", ["t_index_samples"], f"{_ONE_BTREE} AND index_name = '{_ONE_TABLE}_ix2'")
def _(t):
    found = B.index_bloat(t["t_index_samples"], index=f"{_ONE_TABLE}_ix2")["indexes"]
    return found.select(*K.split(", "), *_BTREE_COLUMNS)


@query("m9_one_table_indexes", ["t_index_samples"], f"{_ONE_BTREE} AND table_name = '{_ONE_TABLE}' AND index_size >= 1073741 AND estimated_bloat_percent >= 20")
def _(t):
    """The B-trees of one table; other access methods have no estimate, and are shown beside them by the operator."""
    found = B.index_bloat(t["t_index_samples"], table=_ONE_TABLE, min_index_size_gb=0.001)["indexes"]
    return found.filter("index_type = 'btree'").select(*K.split(", "), *_BTREE_COLUMNS)
