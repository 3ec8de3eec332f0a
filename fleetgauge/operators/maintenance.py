"""Vacuum, freeze, statistics, sizes, sequences and index listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.expressions import (
    XID_LIMIT,
    age_seconds,
    freshness_band,
    not_system_schema,
    pct_ratio,
    percent,
    regex_capture,
    size_pretty,
)
from fleetgauge.functions.frames import Rule, findings, first_names, keyed_join, text, topn, with_settings

BLOCK_SIZE = 8192


def top_objects_by_size(
    tables: DataFrame, indexes: DataFrame, limit: int = 5, block_size: int = BLOCK_SIZE, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The largest tables and the largest indexes by pages."""

    def largest(df: DataFrame, kind: str, name: str) -> DataFrame:
        size = F.col("relpages") * F.lit(block_size).cast("long")
        order = [F.desc_nulls_first("relpages"), F.asc("schemaname"), F.asc(name)]
        return topn(df, limit, order, keys).select(
            *keys,
            F.lit(kind).alias("type"),
            "schemaname",
            F.col(name).alias("object_name"),
            size.alias("size_bytes"),
            size_pretty(size).alias("size"),
        )

    return largest(tables, "table", "relname").unionByName(largest(indexes, "index", "index_name"))


def stale_statistics(tables: DataFrame, limit: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    live = F.greatest(F.col("n_live_tup"), F.lit(1))
    stale = tables.filter((F.col("n_live_tup") > 1000) & (F.col("n_mod_since_analyze") * 10 > live)).select(
        *keys,
        "schemaname",
        "relname",
        "n_live_tup",
        "last_autoanalyze",
        percent("n_mod_since_analyze", live).alias("modified_percent"),
    )
    return topn(stale, limit, [F.desc_nulls_first("modified_percent"), F.asc("schemaname"), F.asc("relname")], keys)


def database_sizes(databases: DataFrame, limit: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    d = databases.filter(~F.col("datistemplate"))
    return topn(d, limit, [F.desc_nulls_first("size_bytes"), F.asc("datname")], keys).select(
        *keys, "datname", "size_bytes", size_pretty("size_bytes").alias("size")
    )


def sequence_exhaustion(sequences: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sequences that do not cycle and have used more than 80 % of their range."""
    last, top = F.col("last_val"), F.col("max_val")
    used = last.cast("decimal(20,0)") * F.lit(10).cast("decimal(2,0)") > top.cast("decimal(20,0)") * F.lit(8).cast(
        "decimal(1,0)"
    )
    return sequences.filter(~F.col("seqcycle") & used).select(
        *keys,
        "schemaname",
        "sequence_name",
        "last_val",
        "max_val",
        (last.cast("double") * 100 / top.cast("double")).alias("percentage_used"),
    )


def freeze_prediction(
    tables: DataFrame,
    settings: DataFrame,
    limit: int = 10,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    """Tables close to, or past, a forced freeze.

    Rows are ranked by the status text, so overdue transaction ids come last; that order decides
    which rows the limit keeps.
    """
    limits = ["autovacuum_freeze_max_age", "autovacuum_multixact_freeze_max_age"]
    kept = tables.filter(F.col("relkind").isin("r", "m") & not_system_schema("schemaname"))
    d = with_settings(kept, settings, limits, keys, settings_keys)
    xid_max = F.col("autovacuum_freeze_max_age").cast("long")
    mxid_max = F.col("autovacuum_multixact_freeze_max_age").cast("long")
    d = d.withColumns(
        {
            "_xid": xid_max - F.col("xid_age"),
            "_mxid": mxid_max - F.col("mxid_age"),
            "_na": (F.col("relminmxid") == 0) | (F.col("mxid_age") == XID_LIMIT),
            "_xid_max": xid_max,
            "_mxid_max": mxid_max,
        }
    )
    xid, mxid, na = F.col("_xid"), F.col("_mxid"), F.col("_na")
    nearest = F.least(xid, mxid)
    status = (
        F.when(xid < 0, "XID_OVERDUE")
        .when(na, "MXID_NA")
        .when(mxid < 0, "MXID_OVERDUE")
        .when(nearest * 10 < F.col("_xid_max"), "CRITICAL")
        .when(nearest * 4 < F.col("_xid_max"), "WARNING")
        .otherwise("OK")
    )
    near = (xid * 4 < F.col("_xid_max")) | (~na & (mxid * 4 < F.col("_mxid_max")))
    rows = d.filter(near).withColumns(
        {"freeze_status": status, "_rank_age": F.least(xid, F.when(na, F.lit(XID_LIMIT)).otherwise(mxid))}
    )
    order = [F.asc("freeze_status"), F.asc("_rank_age"), F.asc("schemaname"), F.asc("relname")]
    return topn(rows, limit, order, keys).select(
        *keys,
        F.col("relname").alias("table_name"),
        "schemaname",
        size_pretty("total_size_bytes").alias("total_size"),
        xid.alias("xid_remain_ages"),
        F.when(~na, mxid).alias("mxid_remain_ages"),
        "freeze_status",
    )


def autovacuum_status(
    settings: DataFrame,
    activity: DataFrame,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
) -> dict[str, DataFrame]:
    keys = list(keys)
    av = settings.filter(F.col("name").startswith("autovacuum"))
    is_worker = F.col("backend_type") == "autovacuum worker"
    workers = activity.filter(is_worker).select(
        *keys,
        "pid",
        F.col("datname").alias("database"),
        regex_capture("query", r"autovacuum: (.*)").alias("operation"),
        "state",
        age_seconds("snapshot_ts", "xact_start").alias("duration_seconds"),
        "wait_event_type",
        "wait_event",
    )
    launcher = topn(activity.filter(F.col("backend_type") == "autovacuum launcher"), 1, [F.asc("pid")], keys).select(
        *keys, "pid", "state", age_seconds("snapshot_ts", "backend_start").alias("uptime_seconds")
    )
    names = ["autovacuum", "autovacuum_max_workers", "autovacuum_naptime"]
    counts = activity.groupBy(*keys).agg(F.count_if(is_worker).alias("active_worker_count"))
    d = with_settings(counts, settings, names, keys, settings_keys)
    max_workers = F.coalesce(F.col("autovacuum_max_workers").cast("long"), F.lit(3).cast("long"))
    naptime = F.coalesce(F.col("autovacuum_naptime").cast("long"), F.lit(60).cast("long"))
    known = F.coalesce(*names).isNotNull()
    enabled = F.when(known, F.coalesce(F.col("autovacuum") == "on", F.lit(False))).otherwise(True)
    summary = d.select(
        *keys,
        enabled.alias("autovacuum_enabled"),
        max_workers.alias("max_workers"),
        "active_worker_count",
        naptime.alias("naptime_seconds"),
        (max_workers - F.col("active_worker_count")).alias("workers_available"),
    )
    busy = Rule(
        "workers_busy",
        F.col("workers_available") == 0,
        "warning",
        F.lit("autovacuum"),
        F.col("active_worker_count"),
        text("no autovacuum worker is free; allow more of them"),
    )
    descr = ["short_desc"] if "short_desc" in settings.columns else []
    when = ["snapshot_ts"] if "snapshot_ts" in settings.columns else []
    return {
        "settings": av.select(*dict.fromkeys([*settings_keys, *when]), "name", "setting", "unit", *descr),
        "launcher": launcher,
        "active_workers": workers,
        "summary": summary,
        "findings": findings(summary, "autovacuum_status", [busy], keys),
    }


def list_indexes(
    index_defs: DataFrame,
    index_stats: DataFrame | None = None,
    table: str | None = None,
    schema: str = "public",
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    """Indexes with their key columns and scan counters (0 when there are none), and totals per table."""
    keys = list(keys)
    own = [*keys, "schema_name", "table_name"]
    d = index_defs.filter(F.col("schema_name") == schema)
    if table:
        d = d.filter(F.col("table_name") == table)
    zero = F.lit(0).cast("long")
    if index_stats is not None:
        stats = index_stats.select(
            *keys,
            F.col("schemaname").alias("schema_name"),
            F.col("relname").alias("table_name"),
            "index_name",
            F.col("idx_scan").alias("scans"),
            F.col("idx_tup_read").alias("tuples_read"),
            F.col("idx_tup_fetch").alias("tuples_fetched"),
        )
        d = d.join(stats, [*own, "index_name"], "left")
    else:
        d = d.withColumns({c: zero for c in ("scans", "tuples_read", "tuples_fetched")})
    rows = d.select(
        *own,
        "index_name",
        "access_method",
        F.array_join("columns", ",").alias("columns"),
        "is_unique",
        "is_primary",
        "is_valid",
        size_pretty("size_bytes").alias("size"),
        "size_bytes",
        "definition",
        *[F.coalesce(c, zero).alias(c) for c in ("scans", "tuples_read", "tuples_fetched")],
    )
    # Totals do not need the scan counters, so they skip that join.
    wanted = index_defs.filter(F.col("schema_name") == schema)
    if table:
        wanted = wanted.filter(F.col("table_name") == table)
    totals = wanted.groupBy(*own).agg(
        F.count(F.lit(1)).alias("index_count"), F.sum(F.coalesce("size_bytes", zero)).alias("total_index_size_bytes")
    )
    return {"indexes": rows, "summary": totals}


def _vacuum_tables(tables: DataFrame, schema: str | None, include_toast: bool) -> DataFrame:
    d = tables.filter((F.col("relkind") == "r") & not_system_schema("schemaname"))
    if schema:
        d = d.filter(F.col("schemaname") == schema)
    if not include_toast:
        d = d.filter(~F.col("relname").startswith("pg_toast"))
    return d


def _trigger_threshold() -> Column:
    base = F.coalesce(F.col("autovacuum_vacuum_threshold").cast("double"), F.lit(50.0))
    scale = F.coalesce(F.col("autovacuum_vacuum_scale_factor").cast("double"), F.lit(0.2))
    return base + scale * F.col("n_live_tup")


_TRIGGER_SETTINGS = ["autovacuum_vacuum_threshold", "autovacuum_vacuum_scale_factor"]


def tables_needing_vacuum(
    tables: DataFrame,
    settings: DataFrame,
    schema: str | None = "public",
    include_toast: bool = False,
    min_dead_tuples: int = 1000,
    limit: int | None = 50,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    """The tables with most dead rows, and whether autovacuum should have run."""
    kept = _vacuum_tables(tables, schema, include_toast).filter(F.col("n_dead_tup") >= min_dead_tuples)
    # Cut before the settings join: neither filter nor order depends on a setting.
    top = topn(kept, limit, [F.desc_nulls_first("n_dead_tup"), F.asc("schemaname"), F.asc("relname")], keys)
    d = with_settings(top, settings, _TRIGGER_SETTINGS, keys, settings_keys)
    threshold = _trigger_threshold()
    return d.select(
        *keys,
        F.col("schemaname").alias("schema_name"),
        F.col("relname").alias("table_name"),
        "n_live_tup",
        "n_dead_tup",
        pct_ratio("n_dead_tup", "n_live_tup").alias("dead_tuple_ratio"),
        "last_vacuum",
        "last_autovacuum",
        "vacuum_count",
        "autovacuum_count",
        size_pretty("table_size_bytes").alias("table_size"),
        "table_size_bytes",
        threshold.alias("autovacuum_threshold"),
        F.coalesce(F.col("n_dead_tup") > threshold, F.lit(False)).alias("exceeds_threshold"),
    )


def tables_near_wraparound(
    tables: DataFrame, min_age: int = 100_000_000, limit: int | None = 20, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The oldest tables of all schemas past ``min_age`` transactions."""
    kept = tables.filter((F.col("relkind") == "r") & not_system_schema("schemaname") & (F.col("xid_age") > min_age))
    return topn(kept, limit, [F.desc_nulls_first("xid_age"), F.asc("schemaname"), F.asc("relname")], keys).select(
        *keys,
        F.col("schemaname").alias("schema_name"),
        F.col("relname").alias("table_name"),
        "xid_age",
        size_pretty("table_size_bytes").alias("table_size"),
        percent("xid_age", F.lit(XID_LIMIT)).alias("pct_towards_wraparound"),
    )


def pending_vacuum(
    tables: DataFrame,
    settings: DataFrame,
    schema: str | None = "public",
    include_toast: bool = False,
    min_dead_tuples: int = 1000,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
    limit: int | None = 50,
    wraparound_limit: int | None = 20,
) -> dict[str, DataFrame]:
    """Tables waiting for a vacuum. The limits (``None``: all) cut the two lists; summary and findings count all tables."""
    keys = list(keys)

    def waiting(n: int | None) -> DataFrame:
        return tables_needing_vacuum(tables, settings, schema, include_toast, min_dead_tuples, n, keys, settings_keys)

    need, old = waiting(None), tables_near_wraparound(tables, limit=None, keys=keys)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def marks(df: DataFrame, dead: Column, exceeds: Column, high: Column, wrap: Column, half: Column) -> DataFrame:
        cols = {"dead": dead, "exceeds": exceeds, "high": high, "wrap": wrap, "half": half}
        return df.select(*keys, *[c.cast("long").alias(name) for name, c in cols.items()])

    counted = (
        marks(need, one, F.col("exceeds_threshold"), F.col("dead_tuple_ratio") > 20, zero, zero)
        .unionByName(marks(old, zero, zero, zero, one, F.col("pct_towards_wraparound") > 50))
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in ("dead", "exceeds", "high", "wrap", "half")])
    )
    rules = [
        Rule(
            "high_dead_ratio",
            F.col("high") > 0,
            "high",
            F.lit("tables"),
            F.col("high"),
            text(F.col("high"), " tables above 20% dead rows; run VACUUM"),
        ),
        Rule(
            "wraparound_half",
            F.col("half") > 0,
            "critical",
            F.lit("tables"),
            F.col("half"),
            text(F.col("half"), " tables past half of the transaction id range; run VACUUM FREEZE"),
        ),
    ]
    return {
        "tables_needing_vacuum": waiting(limit),
        "tables_with_wraparound_risk": tables_near_wraparound(tables, limit=wraparound_limit, keys=keys),
        "summary": counted.select(
            *keys,
            F.col("dead").alias("tables_with_dead_tuples"),
            F.col("exceeds").alias("tables_exceeding_threshold"),
            F.col("wrap").alias("tables_with_wraparound_risk"),
        ),
        "findings": findings(counted, "pending_vacuum", rules, keys),
    }


def autovacuum_trigger(
    tables: DataFrame,
    settings: DataFrame,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    """Dead rows against the trigger threshold, reached when equal; where settings are not known, the server's defaults hold."""
    d = with_settings(tables, settings, _TRIGGER_SETTINGS, keys, settings_keys)
    threshold = _trigger_threshold()
    return d.select(
        *keys,
        "schemaname",
        F.col("relname").alias("table_name"),
        "n_live_tup",
        "n_dead_tup",
        F.rint(threshold).alias("vacuum_trigger_threshold"),
        F.when(F.col("n_dead_tup") >= threshold, "NEEDS VACUUM").otherwise("OK").alias("status"),
        "last_autovacuum",
    )


def vacuum_activity(
    tables: DataFrame,
    schema: str | None = "public",
    include_toast: bool = False,
    limit: int | None = 50,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The most recently vacuumed tables; never vacuumed ones are the first to be cut."""
    last = F.greatest("last_vacuum", "last_autovacuum")
    d = _vacuum_tables(tables, schema, include_toast).withColumn("last_vacuumed", last)
    order = [F.desc_nulls_last("last_vacuumed"), F.asc("schemaname"), F.asc("relname")]
    return topn(d, limit, order, keys).select(
        *keys,
        F.col("schemaname").alias("schema_name"),
        F.col("relname").alias("table_name"),
        "last_vacuum",
        "last_autovacuum",
        "last_analyze",
        "last_autoanalyze",
        "vacuum_count",
        "autovacuum_count",
        "analyze_count",
        "autoanalyze_count",
        "n_live_tup",
        "n_dead_tup",
        "n_mod_since_analyze",
        size_pretty("table_size_bytes").alias("table_size"),
        "last_vacuumed",
        freshness_band("last_vacuumed", "snapshot_ts").alias("vacuum_status"),
    )


def vacuum_history(
    tables: DataFrame,
    schema: str | None = "public",
    include_toast: bool = False,
    keys: Sequence[str] = KEYS,
    limit: int | None = 50,
) -> dict[str, DataFrame]:
    """When tables were vacuumed. The limit (``None``: all) cuts the list; summary and findings count all tables."""
    keys = list(keys)
    recent = vacuum_activity(tables, schema, include_toast, None, keys)
    status = F.col("vacuum_status")
    names = {"never": "never_vacuumed", "stale": "stale_vacuum", "recent": "recent_vacuum", "fresh": "fresh_vacuum"}
    summary = recent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tables"), *[F.count_if(status == s).alias(n) for s, n in names.items()]
    )
    order = [F.desc_nulls_last("last_vacuumed"), F.asc("schema_name"), F.asc("table_name")]
    advice = None
    for band, severity, what in (
        ("never", "warning", " tables without any vacuum so far"),
        ("stale", "info", " tables not vacuumed for over 7 days"),
    ):
        part = first_names(recent.filter(status == band), "table_name", order, keys).select(
            *keys,
            F.lit("vacuum_history").alias("source"),
            F.lit(band).alias("rule"),
            F.lit(severity).alias("severity"),
            F.col("names").alias("subject"),
            F.col("n").cast("double").alias("metric"),
            text(F.col("n"), what).alias("message"),
        )
        advice = part if advice is None else advice.unionByName(part)
    return {"recent_activity": vacuum_activity(tables, schema, include_toast, limit, keys), "summary": summary, "findings": advice}


def free_space_by_table(pages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pages, mean free bytes and mean free share of a page, per table."""
    d = pages.groupBy(*keys, "relname").agg(F.count(F.lit(1)).alias("pages"), F.sum("avail").alias("_free"))
    return d.select(
        *keys,
        "relname",
        "pages",
        size_pretty(F.round(F.col("_free") / F.col("pages")).cast("long")).alias("avg_free_space"),
        percent("_free", F.col("pages") * F.lit(BLOCK_SIZE).cast("long")).alias("avg_free_percent"),
    )
