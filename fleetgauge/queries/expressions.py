"""Scalar expressions over derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.functions import expressions as X
from fleetgauge.functions.frames import topn
from fleetgauge.operators.health import index_columns_array
from fleetgauge.queries.registry import K, SYSTEM, age, hit, lsn, pct0, pretty, query, sized, trunc

T_ID = f"{K}, schemaname, relname"


@query("e1_hit_ratio", ["t_tables"], f"SELECT {T_ID}, {hit('idx_blks_hit', 'idx_blks_read')} AS ratio FROM t_tables")
def _(t):
    return t["t_tables"].select(*T_ID.split(", "), X.hit_ratio("idx_blks_hit", "idx_blks_read").alias("ratio"))


@query(
    "e2_pct_ratio",
    ["t_tables"],
    f"SELECT {T_ID}, {pct0('n_dead_tup', 'n_live_tup')} AS dead, {pct0('idx_scan', 'idx_scan + seq_scan')} AS idx FROM t_tables",
)
def _(t):
    idx = X.pct_ratio("idx_scan", F.col("idx_scan") + F.col("seq_scan"))
    return t["t_tables"].select(*T_ID.split(", "), X.pct_ratio("n_dead_tup", "n_live_tup").alias("dead"), idx.alias("idx"))


@query("e3_trunc_pct", ["t_databases"], f"SELECT {K}, datname, {trunc('xid_age', '2147483647')} AS pct FROM t_databases")
def _(t):
    return t["t_databases"].select(*K.split(", "), "datname", X.trunc_pct("xid_age", F.lit(2147483647)).alias("pct"))


@query(
    "e4_gb_to_bytes",
    ["t_tables"],
    f"SELECT {T_ID}, total_size_bytes >= CAST(trunc(0.005 * 1073741824) AS BIGINT) AS large FROM t_tables",
)
def _(t):
    return t["t_tables"].select(*T_ID.split(", "), (F.col("total_size_bytes") >= X.gb_to_bytes(0.005)).alias("large"))


@query(
    "e5_size_pretty",
    ["t_tables"],
    f"SELECT {T_ID}, {pretty('total_size_bytes')} AS a, {pretty('(n_live_tup * total_size_bytes)')} AS b, "
    f"{pretty('n_dead_tup')} AS c, {pretty('toast_blks_hit')} AS d FROM t_tables",
)
def _(t):
    d = t["t_tables"]
    return d.select(
        *T_ID.split(", "),
        X.size_pretty("total_size_bytes").alias("a"),
        X.size_pretty(F.col("n_live_tup") * F.col("total_size_bytes")).alias("b"),
        X.size_pretty("n_dead_tup").alias("c"),
        X.size_pretty("toast_blks_hit").alias("d"),
    )


@query(
    "e6_format_bytes",
    ["t_tables"],
    f"SELECT {T_ID}, {sized('total_size_bytes')} AS a, CASE WHEN toast_blks_hit IS NULL THEN '0 B' ELSE {sized('toast_blks_hit')} END AS b, "
    f"CASE WHEN coalesce(n_dead_tup, 0) = 0 THEN '0 B' ELSE {sized('n_dead_tup', 1)} END AS c, "
    f"CASE WHEN n_live_tup * total_size_bytes = 0 THEN '0 B' ELSE {sized('(n_live_tup * total_size_bytes)', 1)} END AS d FROM t_tables",
)
def _(t):
    return t["t_tables"].select(
        *T_ID.split(", "),
        X.format_bytes("total_size_bytes").alias("a"),
        X.format_bytes("toast_blks_hit").alias("b"),
        X.format_size("n_dead_tup").alias("c"),
        X.format_size(F.col("n_live_tup") * F.col("total_size_bytes")).alias("d"),
    )


_S = age("snapshot_ts", "query_start")


@query(
    "e7_format_duration",
    ["t_activity"],
    f"SELECT {K}, pid, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' "
    f"ELSE s // 3600 || 'h ' || (s % 3600) // 60 || 'm' END AS took FROM (SELECT {K}, pid, {_S} AS s FROM t_activity)",
)
def _(t):
    return t["t_activity"].select(
        *K.split(", "), "pid", X.format_duration(X.age_seconds("snapshot_ts", "query_start")).alias("took")
    )


@query(
    "e8_size_to_bytes",
    ["t_settings"],
    """SELECT cluster_id, name, CASE WHEN regexp_full_match(setting, '-?[0-9]+') THEN setting::BIGINT ELSE 0 END
       * CASE unit WHEN 'kB' THEN 1024 WHEN '8kB' THEN 8192 WHEN '16kB' THEN 16384 WHEN '32kB' THEN 32768
              WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 ELSE 1 END AS bytes FROM t_settings""",
)
def _(t):
    return t["t_settings"].select("cluster_id", "name", X.size_to_bytes("setting", "unit").alias("bytes"))


@query(
    "e9_lsn",
    ["t_replication"],
    f"SELECT {K}, application_name, {lsn('current_lsn')} AS position, {lsn('current_lsn')} - {lsn('replay_lsn')} AS lag FROM t_replication",
)
def _(t):
    return t["t_replication"].select(
        *K.split(", "),
        "application_name",
        X.lsn_bytes("current_lsn").cast("long").alias("position"),
        X.lsn_diff("current_lsn", "replay_lsn").alias("lag"),
    )


@query(
    "e10_age_seconds",
    ["t_activity"],
    f"SELECT {K}, pid, {_S} AS query_age, {age('snapshot_ts', 'xact_start')} AS xact_age FROM t_activity",
)
def _(t):
    return t["t_activity"].select(
        *K.split(", "),
        "pid",
        X.age_seconds("snapshot_ts", "query_start").alias("query_age"),
        X.age_seconds("snapshot_ts", "xact_start").alias("xact_age"),
    )


@query("e11_left_text", ["t_activity"], f"SELECT {K}, pid, left(query, 12) AS head FROM t_activity")
def _(t):
    return t["t_activity"].select(*K.split(", "), "pid", X.left_text("query", 12).alias("head"))


@query(
    "e12_regex_capture",
    ["t_activity"],
    f"SELECT {K}, pid, CASE WHEN regexp_matches(query, 'autovacuum: (.*)') THEN regexp_extract(query, 'autovacuum: (.*)', 1) END AS operation FROM t_activity",
)
def _(t):
    return t["t_activity"].select(*K.split(", "), "pid", X.regex_capture("query", "autovacuum: (.*)").alias("operation"))


@query(
    "e13_exclude_like",
    ["t_statements"],
    f"SELECT {K}, queryid, query LIKE '%pg_catalog%' AS system, query ILIKE 'select%' AS is_select FROM t_statements "
    "WHERE query NOT LIKE '%$%'",
)
def _(t):
    return t["t_statements"].filter(X.exclude_like("query", ["%$%"])).select(
        *K.split(", "), "queryid", (~X.exclude_like("query")).alias("system"), X.is_select("query").alias("is_select")
    )


@query("e14_not_system_schema", ["t_tables"], f"SELECT {T_ID} FROM t_tables WHERE schemaname NOT IN {SYSTEM}")
def _(t):
    return t["t_tables"].filter(X.not_system_schema("schemaname")).select(*T_ID.split(", "))


@query(
    "e15_prefix_of",
    ["t_index_columns"],
    f"""SELECT {K}, index_name, list_slice(cols, 1, 2) = ['id1', 'created_at2'] AS leads, len(cols) AS n FROM (
        SELECT {K}, index_name, list(column_name ORDER BY pos) AS cols FROM t_index_columns GROUP BY {K}, index_name)""",
)
def _(t):
    arrays = index_columns_array(t["t_index_columns"], [*K.split(", "), "index_name"])
    lead = F.array(F.lit("id1"), F.lit("created_at2"))
    return arrays.select(
        *K.split(", "), "index_name", X.prefix_of("columns", lead).alias("leads"), F.size("columns").cast("long").alias("n")
    )


@query(
    "e16_freshness_band",
    ["t_tables"],
    f"""SELECT {T_ID}, CASE WHEN last_vacuum IS NULL THEN 'never' WHEN last_vacuum < snapshot_ts - INTERVAL 7 DAY THEN 'stale'
        WHEN last_vacuum < snapshot_ts - INTERVAL 1 DAY THEN 'recent' ELSE 'fresh' END AS band FROM t_tables""",
)
def _(t):
    return t["t_tables"].select(*T_ID.split(", "), X.freshness_band("last_vacuum", "snapshot_ts").alias("band"))


@query(
    "e17_band",
    ["t_heap_samples"],
    f"""SELECT {T_ID}, CASE WHEN dead_tuple_percent > 30 THEN 'critical' WHEN dead_tuple_percent > 10 THEN 'warning' ELSE 'normal' END AS dead,
        CAST(CASE WHEN tuple_percent < 50 THEN 3 WHEN tuple_percent < 70 THEN 2 ELSE 0 END AS BIGINT) AS points FROM t_heap_samples""",
)
def _(t):
    return t["t_heap_samples"].select(
        *T_ID.split(", "),
        X.band("dead_tuple_percent", [(">", 30, "critical"), (">", 10, "warning")], "normal").alias("dead"),
        X.band("tuple_percent", [("<", 50, 3), ("<", 70, 2)], 0).cast("long").alias("points"),
    )


@query(
    "topn_per_key",
    ["t_tables"],
    f"SELECT {T_ID}, idx_scan FROM t_tables QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY idx_scan DESC NULLS FIRST, schemaname, relname) <= 7",
)
def _(t):
    order = [F.desc_nulls_first("idx_scan"), F.asc("schemaname"), F.asc("relname")]
    return topn(t["t_tables"], 7, order).select(*T_ID.split(", "), "idx_scan")
