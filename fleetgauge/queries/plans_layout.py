"""Logged plans, index advice, baselines, sources and sinks."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.operators import baseline as X
from fleetgauge.operators import layout as L
from fleetgauge.operators import maintenance as M
from fleetgauge.operators import performance as P
from fleetgauge.plans import explain as E
from fleetgauge.queries.health import index_defs
from fleetgauge.queries.performance import _REPORT, _grown
from fleetgauge.queries.registry import K, fixed, query, rule, top
from fleetgauge.session import shared_dir
from fleetgauge.sources.telemetry import as_json, read_baseline, read_telemetry, write_baseline, write_telemetry

# --- sources and sinks --------------------------------------------------------------------------

_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
    ]
)


@query("io1_read_telemetry", [], "SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'error'")
def _(t):
    raw = read_telemetry(t.spark, t.sf_dir, "events.parquet", schema=_EVENTS, partitioned=False)
    return raw.filter(F.col("event_type") == "error")


_NODES = """SELECT plan_id, node_id, parent_id, CAST(depth AS INTEGER) AS depth, node_type, relation_name, index_name, plan_rows::DOUBLE AS plan_rows, actual_rows::DOUBLE AS actual_rows,
  NULL::DOUBLE AS actual_loops, hash_batches::DOUBLE AS hash_batches, NULL::VARCHAR AS sort_method, filter_cond, startup_cost::DOUBLE AS startup_cost, total_cost::DOUBLE AS total_cost FROM (
SELECT o_orderkey AS plan_id, '1' AS node_id, NULL AS parent_id, 1 AS depth, 'Hash Join' AS node_type, NULL AS relation_name, NULL AS index_name, o_custkey AS plan_rows,
  o_orderkey AS actual_rows, NULL AS hash_batches, NULL AS filter_cond, 1.5 AS startup_cost, o_orderkey * 2 + 0.5::DOUBLE AS total_cost FROM orders
UNION ALL SELECT o_orderkey, '1.1', '1', 2, 'Seq Scan', 't' || o_custkey % 40, NULL, o_orderkey * 3, NULL, NULL, '(a = ''x'')', NULL, NULL FROM orders
UNION ALL SELECT o_orderkey, '1.2', '1', 2, 'Hash', NULL, NULL, NULL, NULL, o_custkey % 4, NULL, NULL, NULL FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT o_orderkey, '1.2.1', '1.2', 3, 'Index Scan', NULL, 'ix_' || o_custkey, NULL, NULL, NULL, NULL, NULL, 8.25 FROM orders WHERE o_orderstatus <> 'O')"""


@query("io2_normalize_plans", [], _NODES.replace("CAST(depth AS INTEGER)", "CAST(depth AS BIGINT)"))
def _(t):
    return E.normalize_plans(t["t_plan_json"])["nodes"].withColumn("depth", F.col("depth").cast("long"))


@query(
    "io2_plan_times",
    [],
    "SELECT o_orderkey AS plan_id, true AS parsed, o_custkey + 0.25::DOUBLE AS execution_time_ms, 0.5::DOUBLE AS planning_time_ms FROM orders",
)
def _(t):
    return E.normalize_plans(t["t_plan_json"])["plans"]


@query(
    "io3_report_json",
    ["t_databases"],
    f"""SELECT {K}, '{{"datname":"' || datname || '","blks_read":' || blks_read || ',"deadlocks":' || deadlocks
      || ',"cluster_id":"' || cluster_id || '","snapshot_ts":"' || strftime(snapshot_ts, '%Y-%m-%dT%H:%M:%S.000') || '"}}' AS json FROM t_databases""",
)
def _(t):
    keys = K.split(", ")
    return as_json(t["t_databases"].select("datname", "blks_read", "deadlocks", *keys), keys)


def _folder(t, name: str) -> str:
    """A new folder that all executors reach."""
    return f"{shared_dir(t.spark)}/fleetgauge-{name}-{uuid.uuid4().hex}"


@query(
    "io1_read_partitioned",
    ["t_activity"],
    f"""SELECT {K}, pid, state FROM t_activity WHERE cluster_id IN ('c1', 'c3') AND snapshot_ts >= TIMESTAMP '2024-01-05' AND snapshot_ts < TIMESTAMP '2024-01-20'""",
)
def _(t):
    """The whole table written twice, as by a retried collector, and read back with pruning by day and cluster."""
    root, rows = _folder(t, "telemetry"), t["t_activity"].select(*K.split(", "), "pid", "state")
    for _ in range(2):
        write_telemetry(rows, root, "activity", run="collector-1")
    found = read_telemetry(t.spark, root, "activity", rows.schema, clusters=["c1", "c3"], since=date(2024, 1, 5), until=date(2024, 1, 20))
    return found.select(*rows.columns)


@query(
    "io3_baseline_table",
    ["t_databases"],
    f"""SELECT {K}, 'databases' AS section, datname AS item, 'size_bytes' AS metric, CAST(size_bytes AS DOUBLE) AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY size_bytes DESC NULLS FIRST, datname) AS r FROM t_databases WHERE NOT datistemplate) d WHERE r <= 10""",
)
def _(t):
    """A baseline written twice, with a second section beside it, and one section read back."""
    path = _folder(t, "baseline")
    sizes = X.baseline_metrics({"databases": M.database_sizes(t["t_databases"])})
    other = sizes.withColumn("section", F.lit("other"))
    for _ in range(2):
        write_baseline(sizes.unionByName(other), path)
    return read_baseline(t.spark, path, sizes.schema, sections=["databases"])


# --- plan rules ---------------------------------------------------------------------------------


def _plan(name: str, severity: str, metric: str, message: str, where: str) -> str:
    return rule("plan", name, severity, "node_id", metric, message, f"FROM n WHERE {where}", "plan_id")


_RATIO = "actual_rows / plan_rows"


@query(
    "p14_lint_plans",
    ["t_plan_nodes"],
    "SELECT * FROM (WITH n AS (SELECT *, coalesce(actual_rows, plan_rows, 0) AS r FROM t_plan_nodes) " + " UNION ALL ".join(
        [
            _plan("seq_scan", "warning", "r", "'sequential scan of ' || relation_name || ' read ' || r::BIGINT || ' rows'", "node_type = 'Seq Scan' AND r > 10000"),
            _plan("seq_scan_filter", "advice", "r", "'consider an index for ' || filter_cond", "node_type = 'Seq Scan' AND r > 10000 AND filter_cond <> ''"),
            _plan("row_estimate", "warning", _RATIO, f"node_type || ': planned ' || plan_rows::BIGINT || ', actual ' || actual_rows::BIGINT || ' rows, ratio ' || {fixed(_RATIO, 2)}", f"plan_rows > 0 AND ({_RATIO} > 10 OR {_RATIO} < 0.1::DOUBLE)"),
            _plan("hash_spill", "warning", "hash_batches", "node_type || ' spilled to disk in ' || hash_batches::BIGINT || ' batches'", "node_type LIKE '%Hash%' AND hash_batches > 1"),
            _plan("sort_spill", "warning", "NULL", "'sort spilled to disk: ' || sort_method", "node_type = 'Sort' AND sort_method ILIKE '%external%'"),
            _plan("nested_loop", "warning", "actual_loops", "'nested loop ran ' || actual_loops::BIGINT || ' times'", "node_type = 'Nested Loop' AND actual_loops > 1000"),
        ]
    ) + ")",
)
def _(t):
    return E.lint_plans(t["t_plan_nodes"])


@query(
    "p14_lint_plan_json",
    [],
    "SELECT * FROM (WITH n AS (SELECT *, coalesce(actual_rows, plan_rows, 0) AS r FROM (" + _NODES + ")) " + " UNION ALL ".join(
        [
            _plan("seq_scan", "warning", "r", "'sequential scan of ' || relation_name || ' read ' || r::BIGINT || ' rows'", "node_type = 'Seq Scan' AND r > 10000"),
            _plan("seq_scan_filter", "advice", "r", "'consider an index for ' || filter_cond", "node_type = 'Seq Scan' AND r > 10000 AND filter_cond <> ''"),
            _plan("row_estimate", "warning", _RATIO, f"node_type || ': planned ' || plan_rows::BIGINT || ', actual ' || actual_rows::BIGINT || ' rows, ratio ' || {fixed(_RATIO, 2)}", f"plan_rows > 0 AND ({_RATIO} > 10 OR {_RATIO} < 0.1::DOUBLE)"),
            _plan("hash_spill", "warning", "hash_batches", "node_type || ' spilled to disk in ' || hash_batches::BIGINT || ' batches'", "node_type LIKE '%Hash%' AND hash_batches > 1"),
        ]
    ) + ")",
)
def _(t):
    return E.lint_plans(E.normalize_plans(t["t_plan_json"])["nodes"])


@query(
    "p15_compare_plans",
    ["t_plan_nodes", "t_plan_nodes_after"],
    """SELECT b.plan_id, b.total_cost AS original_cost, a.total_cost AS cost_with_indexes,
  CASE WHEN b.total_cost > 0 THEN CAST(printf('%.2f', CAST((b.total_cost - a.total_cost) / b.total_cost * 100 AS DOUBLE)) AS DOUBLE) END AS estimated_improvement_percent
FROM t_plan_nodes b JOIN t_plan_nodes_after a ON a.plan_id = b.plan_id AND a.parent_id IS NULL WHERE b.parent_id IS NULL""",
)
def _(t):
    return E.compare_plans(t["t_plan_nodes"], t["t_plan_nodes_after"])


@query(
    "p15_used_indexes",
    ["t_plan_nodes_after", "t_created_indexes"],
    """SELECT plan_id, node_id, index_name, node_type AS scan_type, startup_cost, total_cost FROM t_plan_nodes_after n
WHERE node_type LIKE '%Index%' AND EXISTS (SELECT 1 FROM t_created_indexes c WHERE c.plan_id = n.plan_id AND contains(n.index_name, c.index_name))""",
)
def _(t):
    return E.used_indexes(t["t_plan_nodes_after"], t["t_created_indexes"])


# --- index advice -------------------------------------------------------------------------------

_WORK = f"""(SELECT {K}, queryid FROM t_statements WHERE calls >= 5 AND total_exec_us / calls::DOUBLE >= 5000 AND query NOT LIKE '%pg_catalog%' AND query NOT LIKE '%information_schema%'
  AND query NOT LIKE '%pg_toast%' AND query NOT LIKE '%pg_%' AND query NOT LIKE '%$%' AND query ILIKE 'SELECT%' {top(50, 'total_exec_us DESC, queryid')})"""
_USAGE = """(SELECT DISTINCT u.cluster_id, u.queryid, coalesce(u.table_name, s.t) AS table_name, u.column_name FROM t_column_usage u LEFT JOIN (
  SELECT cluster_id, queryid, min(table_name) AS t FROM t_query_tables GROUP BY ALL HAVING count(DISTINCT table_name) = 1) s USING (cluster_id, queryid)
  WHERE coalesce(u.table_name, s.t) IS NOT NULL)"""
_COLS = f"""(SELECT w.cluster_id, w.snapshot_ts, table_name, column_name, count(DISTINCT queryid) AS statements FROM {_WORK} w JOIN {_USAGE} u USING (cluster_id, queryid) GROUP BY ALL)"""
_CAND = f"""(SELECT {K}, table_name, column_name AS columns, 'single column in use' AS reason FROM {_COLS} UNION ALL
  SELECT {K}, table_name, array_to_string((list(column_name ORDER BY statements DESC, column_name))[1:3], ','), 'several columns in use' FROM {_COLS} GROUP BY {K}, table_name HAVING count(*) > 1)"""
_GAIN = "CAST(round((cost_before - cost_after) / cost_before::DOUBLE * 100, 6) AS DECIMAL(20,6))"
_SCORED = f"""(SELECT {K}, table_name, columns, sign(s) * CAST((2 * CAST(abs(s) * 1000000 AS HUGEINT) + n * 100) // (n * 200) AS DOUBLE) / 10000 AS estimated_improvement_percent, 'serves ' || n || ' of ' || q || ' statements' AS reason FROM (
  SELECT w.cluster_id, w.snapshot_ts, x.table_name, x.candidate_columns AS columns, sum({_GAIN}) AS s, count(*) AS n FROM t_what_if x JOIN {_WORK} w USING (cluster_id, queryid)
  WHERE x.would_use AND cost_before <> 0 AND cost_after > 0 AND {_GAIN} <> 0 GROUP BY ALL) JOIN (SELECT DISTINCT {K}, table_name, columns FROM {_CAND}) USING ({K}, table_name, columns)
  JOIN (SELECT {K}, count(*) AS q FROM {_WORK} GROUP BY ALL) USING ({K}))"""
_SIZES = """(SELECT cluster_id, table_name, columns, 8192 * (1 + leaves + CASE WHEN leaves > 1 THEN (leaves + held - 1) // held ELSE 0 END) AS estimated_size_bytes
FROM (SELECT *, CASE WHEN row_count IS NOT NULL AND held IS NOT NULL THEN greatest((row_count + held - 1) // held, 1) END AS leaves
FROM (SELECT *, CASE WHEN width IS NOT NULL THEN greatest(8152 * 90 // 100 // (12 + 8 * ((width + 7) // 8)), 1) END AS held
FROM (SELECT cluster_id, table_name, columns, CASE WHEN count(avg_width) = count(*) THEN sum(avg_width)::BIGINT END AS width
  FROM (SELECT DISTINCT cluster_id, table_name, columns, unnest(string_split(columns, ',')) AS column_name FROM {base}) c
  LEFT JOIN t_column_widths USING (cluster_id, table_name, column_name) GROUP BY ALL) w
LEFT JOIN t_table_rows USING (cluster_id, table_name)) h) l)"""


def _best(scored: str, n: int = 10, least: int = 10, where: str = "true") -> str:
    return f"""(SELECT *, 'CREATE INDEX ON ' || table_name || ' USING btree (' || replace(columns, ',', ', ') || ')' AS create_statement, 'btree' AS using FROM (
  SELECT * FROM {scored} WHERE estimated_improvement_percent >= {least} AND {where} {top(n, 'estimated_improvement_percent DESC, table_name, columns')}) b
  LEFT JOIN {_SIZES.replace('{base}', scored)} z USING (cluster_id, table_name, columns))"""


_BEST = _best(_SCORED)
_TWO_TABLES = "table_name IN ('t3', 't11')"
#: The caller's statements: those with a query number divisible by seven.
_OWN_WORK = f"(SELECT DISTINCT {K}, queryid FROM t_statements WHERE queryid % 7 = 0)"
_ADVICE = ["t_statements", "t_column_usage", "t_query_tables", "t_what_if", "t_column_widths", "t_table_rows"]


def _advice(t, **options) -> dict:
    return L.recommend_indexes(
        t["t_statements"], t["t_column_usage"], t["t_what_if"], t["t_query_tables"], widths=t["t_column_widths"], table_rows=t["t_table_rows"], store=t.stored, **options
    )


@query("p21_workload_statements", ["t_statements"], f"SELECT * FROM {_WORK}")
def _(t):
    return L.workload_statements(t["t_statements"])


@query("p21_resolved_columns", ["t_column_usage", "t_query_tables"], f"SELECT * FROM {_USAGE}")
def _(t):
    return L.resolve_columns(t["t_column_usage"], t["t_query_tables"])


@query("p21_workload_columns", ["t_statements", "t_column_usage", "t_query_tables"], f"SELECT * FROM {_COLS}")
def _(t):
    usage = L.resolve_columns(t["t_column_usage"], t["t_query_tables"])
    return L.workload_columns(L.workload_statements(t["t_statements"]), usage)


@query("p22_layout_candidates", ["t_statements", "t_column_usage", "t_query_tables"], f"SELECT * FROM {_CAND}")
def _(t):
    return _advice(t)["candidates"]


@query("p23_recommend_layout", _ADVICE, f"SELECT * FROM {_BEST}")
def _(t):
    return _advice(t)["recommendations"]


@query(
    "p23_recommend_for_tables",
    _ADVICE,
    f"SELECT * FROM {_best(_SCORED, 3, 25, where=_TWO_TABLES)}",
)
def _(t):
    return _advice(t, tables=["T3", "t11"], max_recommendations=3, min_improvement_percent=25)["recommendations"]


@query(
    "p23_recommend_for_own_statements",
    _ADVICE,
    f"SELECT * FROM {_best(_SCORED.replace(_WORK, _OWN_WORK), 20, 5)}",
)
def _(t):
    """The caller's statements as workload: those of one query number in seven."""
    own = t["t_statements"].filter("queryid % 7 = 0").select("queryid")
    return _advice(t, own_statements=own, max_recommendations=20, min_improvement_percent=5)["recommendations"]


@query(
    "p23_recommend_summary",
    _ADVICE,
    f"""SELECT {K}, q AS analyzed_queries, coalesce(n, 0) AS total_recommendations FROM (SELECT {K}, count(*) AS q FROM {_WORK} GROUP BY ALL)
LEFT JOIN (SELECT {K}, count(*) AS n FROM {_BEST} GROUP BY ALL) USING ({K})""",
)
def _(t):
    return _advice(t)["summary"]


_OWN = "CASE WHEN cost_before <> 0 AND cost_after > 0 THEN round((cost_before - cost_after) / cost_before::DOUBLE * 100, 4) END"


@query(
    "p23_recommend_for_statement",
    _ADVICE,
    f"""SELECT cluster_id, queryid, table_name, columns, estimated_size_bytes, g AS estimated_improvement_percent,
  CASE WHEN coalesce(g, 0) <> 0 THEN 'cost less by ' || {fixed('g', 1)} || '%' ELSE 'appears in the new plan' END AS reason
FROM (SELECT * FROM (SELECT x.cluster_id, x.queryid, x.table_name, x.candidate_columns AS columns, {_OWN} AS g FROM t_what_if x WHERE x.would_use) y
SEMI JOIN {_CAND} c USING (cluster_id, table_name, columns) {top(5, 'coalesce(g, 0) DESC, table_name, columns', 'cluster_id, queryid')}) b
LEFT JOIN {_SIZES.replace('{base}', _CAND)} z USING (cluster_id, table_name, columns)""",
)
def _(t):
    advice = _advice(t)
    return L.recommend_for_statement(advice["candidates"], t["t_what_if"], sizes=advice["sizes"])


# --- baselines ----------------------------------------------------------------------------------


@query(
    "x2_consecutive_diff_daily",
    ["t_counters"],
    f"SELECT {K}, wal_records, wal_bytes, archived_count FROM {_grown('t_counters', 'cluster_id', ['wal_records', 'wal_bytes', 'archived_count'])}",
)
def _(t):
    d = X.consecutive_diff(t["t_counters"], [], ["wal_records", "wal_bytes", "archived_count"], bucket="week")
    return d.select(*K.split(", "), "wal_records", "wal_bytes", "archived_count")


@query(
    "x2_consecutive_diff_tables",
    ["t_tables"],
    f"SELECT {K}, schemaname, relname, seq_scan, idx_scan FROM {_grown('t_tables', 'cluster_id, schemaname, relname', ['seq_scan', 'idx_scan'])}",
)
def _(t):
    d = X.consecutive_diff(t["t_tables"], ["schemaname", "relname"], ["seq_scan", "idx_scan"], bucket="year")
    return d.select(*K.split(", "), "schemaname", "relname", "seq_scan", "idx_scan")


@query(
    "x2_baseline_diff",
    ["t_tables"],
    f"""SELECT {K}, table_name, CASE WHEN b.n_live_tup IS NULL AND b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'removed'
  WHEN b.n_live_tup = a.n_live_tup AND b.dead_tuple_ratio = a.dead_tuple_ratio THEN 'same' ELSE 'changed' END AS change,
  b.n_live_tup AS n_live_tup_before, a.n_live_tup AS n_live_tup_after, a.n_live_tup - b.n_live_tup AS n_live_tup_delta,
  b.dead_tuple_ratio AS dead_tuple_ratio_before, a.dead_tuple_ratio AS dead_tuple_ratio_after, a.dead_tuple_ratio - b.dead_tuple_ratio AS dead_tuple_ratio_delta
FROM (SELECT cluster_id, snapshot_ts + INTERVAL 1 YEAR AS snapshot_ts, table_name, n_live_tup, dead_tuple_ratio, true AS p FROM ({_REPORT})) b
FULL JOIN (SELECT {K}, table_name, n_live_tup, dead_tuple_ratio, true AS p FROM ({_REPORT})) a USING ({K}, table_name)""",
)
def _(t):
    now = P.table_report(t["t_tables"])
    earlier = now.withColumn("snapshot_ts", F.col("snapshot_ts") + F.expr("INTERVAL 1 YEAR"))
    return X.baseline_diff(earlier, now, [*K.split(", "), "table_name"], ["n_live_tup", "dead_tuple_ratio"])


def _stored_telemetry(t) -> dict:
    """The telemetry of :func:`_telemetry`, what several sections read of it stored once."""
    several = {"tables": "t_tables", "indexes": "t_indexes", "databases": "t_databases", "replication": "t_replication"}
    return _telemetry(t) | {name: t.stored(table) for name, table in several.items()}


def _telemetry(t) -> dict:
    return {
        "activity": t["t_activity"],
        "tables": t["t_tables"],
        "locks": t["t_locks"],
        "replication": t["t_replication"],
        "databases": t["t_databases"],
        "bgwriter": t["t_counters"],
        "settings": t["t_settings"],
        "indexes": t["t_indexes"],
        "index_defs": index_defs(t),
        "statements": t["t_statements"],
    }


def _baseline_sql() -> str:
    from fleetgauge.queries import health as qh
    from fleetgauge.queries import maintenance as qm
    from fleetgauge.queries import performance as qp
    from fleetgauge.queries import sessions as qs
    from fleetgauge.queries.registry import ORACLES

    # 1 GB is the default size limit of the I/O sections, unlike in their own checks.
    table_io = qp._TABLE_IO.replace("10737418", "1073741824")
    index_io = qp._INDEX_IO.replace("10737418", "1073741824")
    checks = qh._ALL
    overall = f"SELECT {K}, CAST(printf('%.1f', CAST(CAST(sum(score) AS DOUBLE) / count(*) AS DOUBLE)) AS DOUBLE) AS overall_score FROM ({checks}) GROUP BY {K}"
    tail = {name: ORACLES[name] for name in ("h7_index_health", "h5_wait_types_all_states", "m3_database_sizes", "m1_top_objects_by_size", "r2_replication_status")}
    frames = {
        "health": overall,
        "health_checks": checks,
        "statements": qp._statements(qp._MEAN, 20),
        "tables": qp._REPORT,
        "buffer_pool": qp._POOL,
        "table_io": table_io,
        "index_io": index_io,
        "index_health": tail["h7_index_health"],
        "wait_events": tail["h5_wait_types_all_states"],
        "databases": tail["m3_database_sizes"],
        "objects": tail["m1_top_objects_by_size"],
        "replication": tail["r2_replication_status"],
    }
    del qm, qs
    parts = []
    for section, text in frames.items():
        names, numbers = X.SECTIONS[section]
        item = " || '.' || ".join(f"CAST({n} AS VARCHAR)" for n in names) if names else "'all'"
        cells = " UNION ALL ".join(
            f"SELECT {K}, '{section}' AS section, {item} AS item, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM s_{section}" for m in numbers
        )
        parts.append((section, text, cells))
    ctes = ", ".join(f"s_{section} AS (SELECT * FROM ({text}))" for section, text, _ in parts)
    return f"SELECT * FROM (WITH {ctes} " + " UNION ALL ".join(cells for _, _, cells in parts) + ")"


_BASELINE_TABLES = ["t_activity", "t_tables", "t_locks", "t_replication", "t_databases", "t_counters", "t_settings", "t_indexes", "t_statements"]


@query("x1_baseline_report", _BASELINE_TABLES, _baseline_sql())
def _(t):
    return X.baseline_metrics(X.baseline_report(_stored_telemetry(t)))


@query(
    "x1_baseline_metrics",
    _BASELINE_TABLES,
    _baseline_sql(),
)
def _(t):
    return X.baseline_pass(_stored_telemetry(t))
