"""Health and availability: wraparound, blocking, security, waits, scoring, index health."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.expressions import (
    XID_LIMIT,
    age_micros,
    age_seconds,
    fixed_text,
    lsn_diff,
    not_system_schema,
    percent,
    round_exact,
    size_pretty,
    size_to_bytes,
    trunc_pct,
    zero_as_missing,
)
from fleetgauge.functions.frames import (
    Rule,
    counter_operator,
    findings,
    keyed_join,
    setting_rows,
    settings_in_force,
    text,
    topn,
    with_settings,
)

# Multixact age limits.
MXID_INVALID_AGE = 2147483647
MXID_CRITICAL_AGE = 2107483647
MXID_WARNING_AGE = 2117483647

# The settings a health check looks at.
CRITICAL_SETTINGS = (
    "shared_buffers",
    "work_mem",
    "maintenance_work_mem",
    "effective_cache_size",
    "huge_pages",
    "temp_buffers",
    "checkpoint_timeout",
    "checkpoint_completion_target",
    "checkpoint_warning",
    "max_wal_size",
    "min_wal_size",
    "wal_level",
    "wal_buffers",
    "wal_compression",
    "synchronous_commit",
    "fsync",
    "full_page_writes",
    "autovacuum",
    "autovacuum_max_workers",
    "autovacuum_naptime",
    "autovacuum_vacuum_threshold",
    "autovacuum_analyze_threshold",
    "autovacuum_vacuum_scale_factor",
    "autovacuum_analyze_scale_factor",
    "autovacuum_vacuum_cost_limit",
    "max_connections",
    "superuser_reserved_connections",
    "tcp_keepalives_idle",
    "tcp_keepalives_interval",
    "statement_timeout",
    "idle_in_transaction_session_timeout",
)
# The settings that have rules.
RULED_SETTINGS = ("shared_buffers", "work_mem", "effective_cache_size", "checkpoint_completion_target", "autovacuum")
# Penalty points by severity.
SEVERITY_PENALTY = {"critical": 40, "high": 20, "medium": 10, "info": 0}
TEMPLATE_DATABASES = ("template0", "template1")
_CONNECTION_SETTINGS = ["max_connections", "superuser_reserved_connections"]


def xid_wraparound(databases: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return databases.filter("datallowconn").select(
        *keys, "datname", "xid_age", trunc_pct("xid_age", F.lit(XID_LIMIT)).alias("percentage_used")
    )


def mxid_wraparound(
    databases: DataFrame,
    settings: DataFrame,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    """Databases whose limit is not known keep their row, without the limit and what follows from it."""
    d = with_settings(
        databases.filter("datallowconn"), settings, ["autovacuum_multixact_freeze_max_age"], keys, settings_keys
    )
    age, limit = F.col("mxid_age"), F.col("autovacuum_multixact_freeze_max_age").cast("long")
    frozen = F.col("datminmxid") == 0
    invalid = age >= MXID_INVALID_AGE
    # The order of the branches is part of the definition, also where one can never be reached.
    status = (
        F.when(frozen, "FROZEN")
        .when(invalid, "INVALID_OR_FROZEN")
        .when(age >= limit, "FORCE_AUTOVACUUM")
        .when(age >= MXID_CRITICAL_AGE, "CRITICAL")
        .when(age >= MXID_WARNING_AGE, "WARNING")
        .otherwise("OK")
    )
    return d.select(
        *keys,
        "datname",
        "mxid_age",
        "datminmxid",
        limit.alias("freeze_max_age"),
        status.alias("status"),
        F.when(~(frozen | invalid), limit - age).alias("remaining_to_autovacuum"),
    )


def wraparound_risk(
    databases: DataFrame,
    settings: DataFrame | None = None,
    type: str = "both",
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
) -> dict[str, DataFrame]:
    out = {}
    if type != "mxid":
        out["xid"] = xid_wraparound(databases, keys)
    if type != "xid":
        out["mxid"] = mxid_wraparound(databases, settings, keys, settings_keys)
    return out


def blocking_edges(activity: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(waiting pid, blocking pid) pairs out of the blocker list on ``activity``; parallel workers repeat a blocker there."""
    return activity.filter(F.size("blocking_pids") > 0).select(
        *keys, "pid", F.explode(F.array_distinct("blocking_pids")).alias("blocking_pid")
    )


def blocking_pairs(
    activity: DataFrame, locks: DataFrame, edges: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per waiting client session, ungranted lock and blocker."""
    keys = list(keys)
    edges = blocking_edges(activity, keys) if edges is None else edges.select(*keys, "pid", "blocking_pid").distinct()
    # The three inputs meet on (key, pid), so each is shuffled once.
    waiting = (
        activity.filter(F.col("backend_type") == "client backend")
        .select(
            *keys,
            "pid",
            F.col("usename").alias("waiting_user"),
            F.col("query").alias("waiting_query"),
            age_seconds("snapshot_ts", "query_start").alias("waiting_duration_seconds"),
        )
        .join(edges, [*keys, "pid"])
        .join(locks.filter(~F.col("granted")).select(*keys, "pid"), [*keys, "pid"])
        .withColumnRenamed("pid", "waiting_pid")
    )
    blocker = activity.select(
        *keys,
        F.col("pid").alias("blocking_pid"),
        F.col("usename").alias("blocking_user"),
        F.col("query").alias("blocking_query"),
        age_seconds("snapshot_ts", "query_start").alias("blocking_duration_seconds"),
    )
    return waiting.join(blocker, [*keys, "blocking_pid"]).select(
        *keys,
        "waiting_pid",
        "waiting_user",
        "waiting_query",
        "waiting_duration_seconds",
        "blocking_pid",
        "blocking_user",
        "blocking_query",
        "blocking_duration_seconds",
    )


@counter_operator(["datname"], ["deadlocks"])
def deadlock_counts(databases: DataFrame, database: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    d = databases if database is None else databases.filter(F.col("datname") == database)
    return d.select(*keys, "datname", "deadlocks")


def connection_security(activity: DataFrame, limit: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    ssl = F.coalesce("ssl", F.lit(False))
    gss = F.coalesce("gss_encrypted", F.lit(False))
    kind = (
        F.when(ssl, "SSL")
        .when(gss, "GSSAPI")
        .when(F.col("client_addr").isNull(), "local")
        .otherwise("unencrypted")
    )
    rows = activity.filter(F.col("backend_type") == "client backend").select(
        *keys,
        "pid",
        "datname",
        "usename",
        "client_addr",
        ssl.alias("ssl_enabled"),
        F.coalesce("ssl_version", F.lit("N/A")).alias("ssl_version"),
        F.coalesce("ssl_cipher", F.lit("N/A")).alias("ssl_cipher"),
        F.coalesce("gss_authenticated", F.lit(False)).alias("gssapi_auth"),
        gss.alias("gssapi_encryption"),
        kind.alias("connection_type"),
    )
    order = [F.asc("connection_type"), F.asc_nulls_last("datname"), F.asc_nulls_last("usename"), F.asc("pid")]
    return topn(rows, limit, order, keys)


def wait_events(activity: DataFrame, active_only: bool = True, keys: Sequence[str] = KEYS) -> dict[str, DataFrame]:
    """Waits by event and by type, the waiting pids in long form, and findings."""
    keys = list(keys)
    base = activity.filter(F.col("backend_type") == "client backend")
    if active_only:
        base = base.filter(F.col("state") == "active")
    named = base.filter(F.col("wait_event").isNotNull())
    by_event = named.groupBy(*keys, "wait_event_type", "wait_event").agg(F.count(F.lit(1)).alias("count"))
    # One row per waiting pid instead of one array per event: an event's pids are not bounded.
    pids = named.select(*keys, "wait_event_type", "wait_event", "pid").distinct()
    by_type = (
        base.filter(F.col("wait_event_type").isNotNull())
        .groupBy(*keys, "wait_event_type")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    kind, n = F.col("wait_event_type"), F.col("count")

    def rule(name: str, bound: int, severity: str, message: str) -> Rule:
        return Rule(name, (kind == name) & (n > bound), severity, kind, n, text(n, message))

    advice = findings(
        by_type,
        "wait_events",
        [
            rule("Lock", 5, "warning", " sessions wait for locks; look at the blocking sessions"),
            rule("IO", 10, "warning", " sessions wait for I/O; review I/O settings and shared_buffers"),
            rule("BufferPin", 0, "warning", " sessions wait for buffer pins; hot pages are contended"),
        ],
        keys,
    )
    return {"wait_events": by_event, "pids": pids, "by_type": by_type, "findings": advice}


# --- health check -------------------------------------------------------------------------------


# Each check is a cell: a struct for keys whose telemetry is present, else NULL. A check on its own
# turns the facts of one table into its cell; the whole health check merges the facts of all tables
# into one row per key first, so every table is read and aggregated once.


def _cell(name: str, present: Column, score: Column, metric: Column, second: Column) -> Column:
    return F.when(
        present,
        F.struct(
            F.lit(name).alias("check_name"),
            F.greatest(F.lit(0), score).cast("long").alias("score"),
            metric.cast("double").alias("metric"),
            second.cast("double").alias("second_metric"),
        ),
    )


def _rows_of(df: DataFrame, cells: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))


def blocked_session() -> Column:
    return F.coalesce((F.col("wait_event_type") == "Lock") & (F.col("state") == "active"), F.lit(False))


def activity_facts(activity: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return activity.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("used"), F.count_if(blocked_session()).alias("blocking_queries")
    )


def lock_facts(locks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return locks.groupBy(*keys).agg(F.count_if(~F.col("granted")).alias("waiting_locks"))


def cache_facts(tables: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    counters = ("heap_blks_hit", "heap_blks_read", "idx_blks_hit", "idx_blks_read")
    return tables.groupBy(*keys).agg(F.count(F.lit(1)).alias("tables"), *[F.sum(c).alias(c) for c in counters])


def replication_facts(replication: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    lag = F.coalesce(lsn_diff("sent_lsn", "replay_lsn"), F.lit(0).cast("long"))
    return replication.groupBy(*keys).agg(F.count(F.lit(1)).alias("replicas"), F.max(lag).alias("lag"))


def database_facts(databases: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    own = ~F.col("datname").isin(*TEMPLATE_DATABASES)
    return databases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("any_database"),
        F.count_if(own).alias("databases"),
        # The five oldest databases are looked at; their maximum is the overall maximum.
        F.max(F.when(own, F.col("xid_age"))).alias("xid_age"),
        F.sum(F.when(own, F.col("size_bytes"))).alias("total_size"),
    )


def bgwriter_facts(bgwriter: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key already; the age of the counters replaces their reset time."""
    counters = ("checkpoints_timed", "checkpoints_req", "buffers_checkpoint", "buffers_clean", "buffers_backend")
    return bgwriter.select(*keys, *counters, age_micros("snapshot_ts", "stats_reset").alias("reset_micros"))


def _connections_cell() -> Column:
    limit, reserved = F.col("max_connections").cast("long"), F.col("superuser_reserved_connections").cast("long")
    pct = percent("used", limit, 1)
    score = F.when(pct > 90, 30).when(pct > 75, 70).otherwise(100)
    present = F.col("used").isNotNull() & limit.isNotNull() & reserved.isNotNull()
    return _cell("connections", present, score, pct, reserved)


def _cache_cell() -> Column:
    def ratio(hit: str, read: str) -> Column:
        return F.coalesce(percent(F.col(hit), F.col(hit) + F.col(read)), F.lit(0.0))

    heap, idx = ratio("heap_blks_hit", "heap_blks_read"), ratio("idx_blks_hit", "idx_blks_read")
    score = 100 - F.when(heap < 90, 30).otherwise(0) - F.when(idx < 95, 20).otherwise(0)
    return _cell("cache", F.col("tables").isNotNull(), score, heap, idx)


def _locks_cell() -> Column:
    zero = F.lit(0).cast("long")
    waiting, blocked = F.coalesce("waiting_locks", zero), F.coalesce("blocking_queries", zero)
    penalty = F.when(waiting > 10, 40).when(waiting > 5, 20).otherwise(0) + F.when(blocked > 0, 30).otherwise(0)
    present = F.col("waiting_locks").isNotNull() | F.col("blocking_queries").isNotNull()
    return _cell("locks", present, 100 - penalty, waiting, blocked)


def _replication_cell(present: Column) -> Column:
    lag, mib = F.col("lag"), 1024 * 1024
    score = F.when(lag > 100 * mib, 50).when(lag > 10 * mib, 80).otherwise(100)
    return _cell("replication", present, score, lag, F.coalesce("replicas", F.lit(0).cast("long")))


def _wraparound_cell() -> Column:
    pct = F.coalesce(percent("xid_age", F.lit(XID_LIMIT)), F.lit(0.0))
    score = F.when(pct > 75, 20).when(pct > 50, 70).otherwise(100)
    return _cell("wraparound", F.col("databases") > 0, score, pct, F.col("xid_age"))


def _disk_cell() -> Column:
    return _cell("disk_usage", F.col("databases") > 0, F.lit(100), F.col("total_size"), F.col("databases"))


def _bgwriter_cell(zero_is_missing: bool = True) -> Column:
    timed, requested = F.col("checkpoints_timed"), F.col("checkpoints_req")
    written = F.col("buffers_checkpoint") + F.col("buffers_clean") + F.col("buffers_backend")
    timed_pct = F.coalesce(percent(timed, timed + requested, 1), F.lit(100.0))
    timed_pct = zero_as_missing(timed_pct, 100, zero_is_missing)
    backend_pct = F.coalesce(percent(F.col("buffers_backend"), written, 1), F.lit(0.0))
    score = 100 - F.when(timed_pct < 90, 20).otherwise(0) - F.when(backend_pct > 20, 30).otherwise(0)
    return _cell("bgwriter", timed.isNotNull(), score, timed_pct, backend_pct)


def _checkpoints_cell() -> Column:
    total = F.col("checkpoints_timed") + F.col("checkpoints_req")
    # 3600 * total / seconds with two decimals; the percent form supplies the exact rounding.
    scaled = total * F.lit(36_000_000).cast("long")
    per_hour = F.coalesce(percent(scaled, F.col("reset_micros")), F.lit(0.0))
    score = F.when(per_hour > 6, 70).otherwise(100)
    return _cell("checkpoints", F.col("checkpoints_timed").isNotNull(), score, per_hour, total)


def check_connections(
    activity: DataFrame,
    settings: DataFrame,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    d = with_settings(activity_facts(activity, keys), settings, _CONNECTION_SETTINGS, keys, settings_keys)
    return _rows_of(d, [_connections_cell()], keys)


def check_cache(tables: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _rows_of(cache_facts(tables, keys), [_cache_cell()], keys)


def lock_counts(locks: DataFrame, activity: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Total and waiting locks, waiting processes and blocked sessions per key, in one aggregate."""
    waiting = ~F.col("granted")
    both = locks.select(
        *keys,
        F.lit(1).alias("is_lock"),
        waiting.alias("waits"),
        F.when(waiting, F.col("pid")).alias("wait_pid"),
        F.lit(False).alias("blocked"),
    ).unionByName(
        activity.select(
            *keys,
            F.lit(0).alias("is_lock"),
            F.lit(False).alias("waits"),
            F.lit(None).cast("long").alias("wait_pid"),
            blocked_session().alias("blocked"),
        )
    )
    return both.groupBy(*keys).agg(
        F.sum("is_lock").cast("long").alias("total_locks"),
        F.count_if("waits").alias("waiting_locks"),
        F.count_distinct("wait_pid").alias("waiting_processes"),
        F.count_if("blocked").alias("blocking_queries"),
    )


def check_locks(locks: DataFrame, activity: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    facts = _merged([lock_facts(locks, keys), activity_facts(activity, keys)], keys)
    return _rows_of(facts, [_locks_cell()], keys)


def check_replication(
    replication: DataFrame, all_keys: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Worst replay lag; keys of ``all_keys`` without replicas score 100."""
    facts = [replication_facts(replication, keys)]
    if all_keys is not None:
        facts.append(all_keys.select(*keys))
    return _rows_of(_merged(facts, keys), [_replication_cell(F.lit(True))], keys)


def check_wraparound(databases: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _rows_of(database_facts(databases, keys), [_wraparound_cell()], keys)


def check_disk_usage(databases: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _rows_of(database_facts(databases, keys), [_disk_cell()], keys)


def check_bgwriter(bgwriter: DataFrame, zero_is_missing: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    return _rows_of(bgwriter_facts(bgwriter, keys), [_bgwriter_cell(zero_is_missing)], keys)


def check_checkpoints(bgwriter: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _rows_of(bgwriter_facts(bgwriter, keys), [_checkpoints_cell()], keys)


def _merged(facts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Frames with at most one row per key side by side: a union and one small aggregate, no joins."""
    out = facts[0]
    for part in facts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    values = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def _own_keys(settings: DataFrame, settings_keys: Sequence[str]) -> list[str]:
    """The keys of settings as collected: their snapshot counts if they have one."""
    timed = "snapshot_ts" in settings.columns and "snapshot_ts" not in settings_keys
    return [*settings_keys, "snapshot_ts"] if timed else list(settings_keys)


def _setting_rules() -> list[Rule]:
    """What is wrong with a watched setting, over the columns name, setting and unit."""
    value, unit, name = F.col("setting"), F.col("unit"), F.col("name")
    size = size_to_bytes(value, unit)
    current = F.concat(value, F.coalesce(unit, F.lit("")))

    def rule(setting: str, severity: str, when: Column, advice: str) -> Rule:
        metric = F.coalesce(value.try_cast("double"), F.lit(0.0))
        return Rule(setting, (name == setting) & when, severity, name, metric, text(name, " = ", current, ": ", advice))

    return [
        rule("shared_buffers", "high", size < 128 * 1024**2, "raise towards a quarter of system memory"),
        rule("work_mem", "medium", size < 4 * 1024**2, "raise for complex queries"),
        rule("effective_cache_size", "info", F.lit(True), "expected near three quarters of system memory"),
        rule(
            "checkpoint_completion_target",
            "medium",
            value.try_cast("double") < 0.9,
            "raise to 0.9 to spread checkpoint writes",
        ),
        rule("autovacuum", "critical", value == "off", "turn on to prevent wraparound"),
    ]


def settings_findings(settings: DataFrame, settings_keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Advice on the watched settings, one row per setting (and snapshot of it) that deserves it."""
    return findings(settings, "settings", _setting_rules(), _own_keys(settings, settings_keys))


def settings_penalty(settings: DataFrame, settings_keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Penalty points and number of findings per settings key (and snapshot), also where there are none."""
    points, found = F.lit(0), F.lit(0)
    for rule in _setting_rules():
        hit = F.coalesce(rule.when, F.lit(False))
        points = points + F.when(hit, SEVERITY_PENALTY.get(rule.severity, 0)).otherwise(0)
        found = found + F.when(hit, 1).otherwise(0)
    rows = settings.groupBy(*_own_keys(settings, settings_keys))
    return rows.agg(F.sum(points).alias("settings_penalty"), F.sum(found).alias("settings_findings"))


def _settings_cell(present: Column) -> Column:
    penalty, found = F.col("settings_penalty"), F.col("settings_findings")
    return _cell("settings", present & penalty.isNotNull(), 100 - penalty, penalty, found)


def check_settings(settings: DataFrame, settings_keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Score per settings key (and snapshot): 100 minus the penalties of the findings."""
    keys = _own_keys(settings, settings_keys)
    return _rows_of(settings_penalty(settings, keys), [_settings_cell(F.lit(True))], keys)


def checks_of_facts(
    facts: DataFrame, settings: DataFrame, keys: Sequence[str] = KEYS, settings_keys: Sequence[str] = ("cluster_id",)
) -> DataFrame:
    """The facts, one row per key, with the connection limits, the settings' penalty, and ``checks``, the array of all present checks."""
    # Limits and penalty are worked out once per interval of the settings, of which there are few, and met by the facts once.
    names = [*_CONNECTION_SETTINGS, *RULED_SETTINGS]
    found = settings_in_force(settings, names, keys, settings_keys)
    limits = [F.col(n)["setting"].alias(f"_{n}") for n in _CONNECTION_SETTINGS]
    validity = ["_to"] if found.timed else []
    rows = setting_rows(found, names, [*validity, *limits])
    by = [*found.own_keys(), *validity, *[f"_{n}" for n in _CONNECTION_SETTINGS]]
    penalty = settings_penalty(rows, by).withColumnsRenamed({f"_{n}": n for n in _CONNECTION_SETTINGS})
    d = replace(found, frame=penalty).attach(facts)
    # A key was observed when its sessions, databases or counters were; then no replica is a fact.
    observed = F.coalesce("used", "any_database", "checkpoints_timed").isNotNull()
    cells = [
        _connections_cell(),
        _cache_cell(),
        _locks_cell(),
        _replication_cell(observed | F.col("replicas").isNotNull()),
        _wraparound_cell(),
        _disk_cell(),
        _bgwriter_cell(),
        _checkpoints_cell(),
        _settings_cell(observed),
    ]
    return d.withColumn("checks", F.filter(F.array(*cells), lambda c: c.isNotNull()))


def health_checks(
    activity: DataFrame,
    tables: DataFrame,
    locks: DataFrame,
    replication: DataFrame,
    databases: DataFrame,
    bgwriter: DataFrame,
    settings: DataFrame,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    """All nine checks in long form; a check whose telemetry is absent for a key has no row."""
    facts = health_facts(activity, tables, locks, replication, databases, bgwriter, keys)
    return checks_of_facts(facts, settings, keys, settings_keys).select(*keys, F.inline("checks"))


def health_facts(
    activity: DataFrame,
    tables: DataFrame,
    locks: DataFrame,
    replication: DataFrame,
    databases: DataFrame,
    bgwriter: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """What the checks look at, one row per key of any table."""
    keys = list(keys)
    parts = [
        activity_facts(activity, keys),
        lock_facts(locks, keys),
        cache_facts(tables, keys),
        replication_facts(replication, keys),
        database_facts(databases, keys),
        bgwriter_facts(bgwriter, keys),
    ]
    return _merged(parts, keys)


def health_details(
    facts: DataFrame,
    replication: DataFrame,
    databases: DataFrame,
    settings: DataFrame,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
    oldest: int | None = 5,
) -> dict[str, DataFrame]:
    """What stands behind each check, lazily, by its name: the numbers of a key, or the rows they come from.

    ``facts`` is the result of :func:`checks_of_facts`. Replication lists the replicas with their lag, wraparound the ``oldest``
    databases (``None``: all), disk usage all databases by size, settings the watched ones as collected.
    """
    keys, zero = list(keys), F.lit(0).cast("long")
    limit = F.col("max_connections").cast("long")
    timed, requested = F.col("checkpoints_timed"), F.col("checkpoints_req")
    written = F.col("buffers_checkpoint") + F.col("buffers_clean") + F.col("buffers_backend")
    own = databases.filter(~F.col("datname").isin(*TEMPLATE_DATABASES))
    by_age = topn(own, oldest, [F.desc_nulls_last("xid_age"), F.asc("datname")], keys)
    lag = F.coalesce(lsn_diff("sent_lsn", "replay_lsn"), zero)
    return {
        "connections": facts.filter("used is not null").select(
            *keys,
            F.col("used").alias("total_connections"),
            limit.alias("max_connections"),
            F.col("superuser_reserved_connections").cast("long").alias("superuser_reserved"),
            percent("used", limit, 1).alias("used_percent"),
        ),
        "cache": facts.filter("tables is not null").select(
            *keys,
            "heap_blks_hit",
            "heap_blks_read",
            F.coalesce(percent("heap_blks_hit", F.col("heap_blks_hit") + F.col("heap_blks_read")), F.lit(0.0)).alias("heap_hit_ratio"),
            "idx_blks_hit",
            "idx_blks_read",
            F.coalesce(percent("idx_blks_hit", F.col("idx_blks_hit") + F.col("idx_blks_read")), F.lit(0.0)).alias("index_hit_ratio"),
        ),
        "locks": facts.filter("waiting_locks is not null or blocking_queries is not null").select(
            *keys, F.coalesce("waiting_locks", zero).alias("waiting_locks"), F.coalesce("blocking_queries", zero).alias("blocking_queries")
        ),
        "replication": replication.select(*keys, "application_name", "client_addr", "state", "sync_state", lag.alias("lag_bytes")),
        "wraparound": by_age.select(
            *keys, "datname", "xid_age", (F.lit(XID_LIMIT) - F.col("xid_age")).alias("xids_remaining"), percent("xid_age", F.lit(XID_LIMIT)).alias("used_percent")
        ),
        "disk_usage": own.select(*keys, "datname", size_pretty("size_bytes").alias("size"), "size_bytes"),
        "bgwriter": facts.filter("checkpoints_timed is not null").select(
            *keys,
            "checkpoints_timed",
            "checkpoints_req",
            F.coalesce(percent(timed, timed + requested, 1), F.lit(100.0)).alias("timed_percent"),
            "buffers_checkpoint",
            "buffers_clean",
            "buffers_backend",
            F.coalesce(percent("buffers_backend", written, 1), F.lit(0.0)).alias("backend_write_percent"),
        ),
        "checkpoints": facts.filter("checkpoints_timed is not null").select(
            *keys,
            (timed + requested).alias("total_checkpoints"),
            (F.col("reset_micros") / 1e6).alias("seconds_since_reset"),
            F.coalesce(percent((timed + requested) * F.lit(36_000_000).cast("long"), F.col("reset_micros")), F.lit(0.0)).alias("checkpoints_per_hour"),
        ),
        "settings": settings.filter(F.col("name").isin(*CRITICAL_SETTINGS)).select(*_own_keys(settings, settings_keys), "name", "setting", "unit"),
    }


def overall_health(checks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the present checks (one decimal, ties to even) and its band."""
    d = checks.groupBy(*keys).agg(
        round_exact(F.sum("score") / F.count(F.lit(1)), 1).alias("overall_score"), F.count(F.lit(1)).alias("checks")
    )
    score = F.col("overall_score")
    return d.withColumn("status", F.when(score >= 90, "healthy").when(score >= 70, "warning").otherwise("critical"))


def health_findings(checks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Issues and advice that follow from the check rows."""
    name, m, s = F.col("check_name"), F.col("metric"), F.col("second_metric")
    mib = 1024 * 1024

    def rule(rule_name: str, check: str, when: Column, severity: str, metric: Column, message: Column) -> Rule:
        return Rule(rule_name, (name == check) & when, severity, name, metric, message)

    whole = [m.cast("long"), s.cast("long")]
    rules = [
        rule("connections_over_90", "connections", m > 90, "critical", m, text("over 90% of the connections are taken")),
        rule("connections_pooling", "connections", m > 90, "advice", m, text("raise max_connections or pool")),
        rule("connections_over_75", "connections", (m > 75) & (m <= 90), "warning", m, text("over 75% of the connections are taken")),
        rule("heap_hit_low", "cache", m < 90, "warning", m, text("buffer cache hit ratio is ", fixed_text(m, 2), "%")),
        rule("heap_hit_advice", "cache", m < 90, "advice", m, text("raise shared_buffers")),
        rule("index_hit_low", "cache", s < 95, "warning", s, text("index cache hit ratio is ", fixed_text(s, 2), "%")),
        rule("lock_contention", "locks", m > 10, "warning", m, text(whole[0], " lock requests not granted")),
        rule("blocked_sessions", "locks", s > 0, "warning", s, text(whole[1], " sessions held up by a lock")),
        rule("blocked_advice", "locks", s > 0, "advice", s, text("look at the blocking sessions")),
        rule("lag_high", "replication", m > 100 * mib, "critical", m, text("replication lag above 100 MiB")),
        rule(
            "lag_moderate",
            "replication",
            (m > 10 * mib) & (m <= 100 * mib),
            "warning",
            m,
            text("replication lag above 10 MiB"),
        ),
        rule("wraparound_75", "wraparound", m > 75, "critical", m, text("wraparound at ", fixed_text(m, 2), "%")),
        rule("wraparound_75_advice", "wraparound", m > 75, "advice", m, text("run VACUUM FREEZE now")),
        rule(
            "wraparound_50",
            "wraparound",
            (m > 50) & (m <= 75),
            "warning",
            m,
            text("wraparound at ", fixed_text(m, 2), "%"),
        ),
        rule("wraparound_50_advice", "wraparound", (m > 50) & (m <= 75), "advice", m, text("schedule VACUUM FREEZE")),
        rule(
            "requested_checkpoints",
            "bgwriter",
            m < 90,
            "warning",
            m,
            text(fixed_text(100 - m, 1), "% of checkpoints were not timed"),
        ),
        rule("checkpoint_spacing", "bgwriter", m < 90, "advice", m, text("raise checkpoint_timeout or max_wal_size")),
        rule(
            "backend_writes", "bgwriter", s > 20, "warning", s, text(fixed_text(s, 1), "% of buffers written by backends")
        ),
        rule("backend_writes_advice", "bgwriter", s > 20, "advice", s, text("raise shared_buffers or tune bgwriter")),
        rule(
            "checkpoint_rate", "checkpoints", m > 6, "warning", m, text(fixed_text(m, 2), " checkpoints per hour")
        ),
        rule("checkpoint_rate_advice", "checkpoints", m > 6, "advice", m, text("space checkpoints further apart")),
    ]
    return findings(checks, "health_check", rules, keys)


def health_check(
    activity: DataFrame,
    tables: DataFrame,
    locks: DataFrame,
    replication: DataFrame,
    databases: DataFrame,
    bgwriter: DataFrame,
    settings: DataFrame,
    include_recommendations: bool = True,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
    verbose: bool = False,
) -> dict[str, DataFrame | dict[str, DataFrame]]:
    """Checks, overall score, findings; with ``verbose`` also ``details``, the :func:`health_details` of the same facts."""
    keys = list(keys)
    facts = checks_of_facts(health_facts(activity, tables, locks, replication, databases, bgwriter, keys), settings, keys, settings_keys)
    checks = facts.select(*keys, F.inline("checks"))
    notes = health_findings(checks, keys)
    by_setting = settings_findings(settings, settings_keys)
    if not include_recommendations:
        notes = notes.filter(F.col("severity") != "advice")
        by_setting = by_setting.filter(F.col("severity").isin("critical", "high"))
    out = {
        "checks": checks,
        "overall": overall_health(checks, keys),
        "findings": notes,
        "settings_findings": by_setting,
    }
    return out | ({"details": health_details(facts, replication, databases, settings, keys, settings_keys)} if verbose else {})


# --- index health -------------------------------------------------------------------------------


def invalid_indexes(indexes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Invalid indexes of all schemas."""
    return indexes.filter(~F.col("is_valid")).select(
        *keys, "index_name", F.col("schemaname").alias("schema_name"), F.col("relname").alias("table_name")
    )


def _never_used(schema: str, min_size_mb: float, primary_key_names: str = "%_pkey") -> Column:
    return (
        (F.col("schemaname") == schema)
        & not_system_schema("schemaname")
        & (F.col("size_bytes") >= min_size_mb * 1024 * 1024)
        & ~F.col("index_name").like(primary_key_names)
        & (F.col("idx_scan") == 0)
    )


def unused_indexes(
    indexes: DataFrame,
    tables: DataFrame,
    schema: str = "public",
    min_size_mb: float = 0,
    keys: Sequence[str] = KEYS,
    primary_key_names: str = "%_pkey",
) -> DataFrame:
    """Never scanned, not a primary key by name, at least the given size.

    ``primary_key_names`` is a LIKE pattern, whose underscore stands for any character unless a backslash precedes it.
    """
    candidates = indexes.filter(_never_used(schema, min_size_mb, primary_key_names))
    rows = tables.select(*keys, "schemaname", "relname", F.col("n_live_tup").alias("table_rows"))
    return candidates.join(rows, [*keys, "schemaname", "relname"]).select(
        *keys,
        "schemaname",
        F.col("relname").alias("table_name"),
        "index_name",
        F.col("idx_scan").alias("scans"),
        F.col("idx_tup_read").alias("tuples_read"),
        F.col("idx_tup_fetch").alias("tuples_fetched"),
        size_pretty("size_bytes").alias("size"),
        "size_bytes",
        "definition",
        "table_rows",
    )


def index_facts(
    indexes: DataFrame, tables: DataFrame, schema: str = "public", min_size_mb: float = 0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """What each index adds to the counts of a key, from one reading of the indexes; as :func:`invalid_indexes` and :func:`unused_indexes`."""
    table, zero = ["relname", "schemaname", *reversed(keys)], F.lit(0).cast("long")
    listed = tables.groupBy(*table).agg(F.count(F.lit(1)).alias("_tables"))
    unused = F.when(F.col("_never_used"), F.coalesce("_tables", zero)).otherwise(zero)
    return (
        indexes.select(*table, "is_valid", "size_bytes", _never_used(schema, min_size_mb).alias("_never_used"))
        .join(listed, table, "left")
        .select(
            *keys,
            F.lit(1).cast("long").alias("indexes"),
            F.when(~F.col("is_valid"), 1).otherwise(0).cast("long").alias("invalid_indexes"),
            unused.alias("unused_indexes"),
            (unused * F.coalesce("size_bytes", zero)).alias("potential_savings_bytes"),
        )
    )


def index_columns_array(index_columns: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Long (position, column) rows to one ordered array per index (an index has few key columns).

    Groups are sorted by the last id first: names differ early, where clusters and moments are shared by many rows.
    """
    pairs = F.array_sort(F.collect_list(F.struct("pos", "column_name")))
    grouped = index_columns.groupBy(*reversed(id_cols)).agg(F.transform(pairs, lambda p: p["column_name"]).alias("columns"))
    return grouped.select(*id_cols, "columns")


def duplicate_indexes(
    index_defs: DataFrame, schema: str = "public", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Index pairs of one table where the second's columns lead the first's.

    Each index offers its column prefixes (at most its key width) and meets the indexes whose whole
    column list equals one of them: an equi join that touches true pairs only, instead of all pairs
    of a table.
    """
    own = ["schema_name", "table_name"]
    d = index_defs.filter((F.col("schema_name") == schema) & not_system_schema("schema_name") & (F.size("columns") > 0))
    first = d.select(
        *keys,
        *own,
        F.col("index_name").alias("index1"),
        F.col("columns").alias("columns1"),
        F.col("definition").alias("definition1"),
        F.col("size_bytes").alias("size1"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("columns")), lambda i: F.slice("columns", F.lit(1), i))).alias(
            "columns2"
        ),
    )
    second = d.select(
        *keys,
        *own,
        F.col("columns").alias("columns2"),
        F.col("index_name").alias("index2"),
        F.col("definition").alias("definition2"),
        F.col("size_bytes").alias("size2"),
    )
    same = F.size("columns1") == F.size("columns2")
    return (
        first.join(second, [*reversed([*keys, *own]), "columns2"])
        .filter(F.col("index1") < F.col("index2"))
        .select(
            *keys,
            *own,
            "index1",
            F.array_join("columns1", ",").alias("columns1"),
            "definition1",
            "size1",
            "index2",
            F.array_join("columns2", ",").alias("columns2"),
            "definition2",
            "size2",
            F.when(same, "duplicate").otherwise("overlapping").alias("relationship"),
        )
    )


def duplicate_counts(index_defs: DataFrame, schema: str = "public", keys: Sequence[str] = KEYS) -> DataFrame:
    """The number of pairs of :func:`duplicate_indexes` that each index is second in (``pairs``), without making the pairs.

    All prefixes of a table's indexes are ranked by index name within equal lists; a whole list is second to those before it.
    """
    own = [*reversed([*keys, "schema_name", "table_name"])]
    d = index_defs.filter((F.col("schema_name") == schema) & not_system_schema("schema_name") & (F.size("columns") > 0))
    leads = F.transform(
        F.sequence(F.lit(1), F.size("columns")),
        lambda i: F.struct(F.slice("columns", F.lit(1), i).alias("lead"), (i == F.size("columns")).alias("whole")),
    )
    each = d.select(*own, "index_name", F.inline(leads))
    before = F.rank().over(Window.partitionBy(*own, "lead").orderBy("index_name")) - 1
    return each.withColumn("pairs", before.cast("long")).filter("whole and pairs > 0").select(*keys, "index_name", "pairs")


def index_classes(index_defs: DataFrame, schema: str = "public", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per index: its class of indexes with the same columns, and how the column lists of a table lead one another.

    ``class_size`` and ``representative`` (the first name) describe the class; ``extends`` is the representative of the longest stored
    list that leads this one, ``extended_by`` the number of classes whose longest stored lead this list is. ``relationship`` is
    "duplicate" for all but the representative, "leading" where a longer list begins with this one, else "single". The result is as
    long as the input however many indexes share a list; :func:`duplicate_indexes` has the pairs. Definitions are not moved: the
    prefix chains are made of the distinct lists alone.
    """
    # Names first: sorts end early where rows differ early.
    own = [*reversed([*keys, "schema_name", "table_name"])]
    d = index_defs.filter((F.col("schema_name") == schema) & not_system_schema("schema_name") & (F.size("columns") > 0))
    d = d.select(*own, "columns", "index_name")
    lists = d.groupBy(*own, "columns").agg(F.count(F.lit(1)).alias("class_size"), F.min("index_name").alias("representative"))
    shorter = F.transform(F.sequence(F.lit(1), F.size("columns") - 1), lambda i: F.slice("columns", F.lit(1), i))
    leads = lists.filter(F.size("columns") > 1).select(*own, "columns", F.explode(shorter).alias("lead"))
    stored = lists.select(*own, F.col("columns").alias("lead"), F.col("representative").alias("extends"))
    longest = F.max(F.struct(F.size("lead").alias("n"), "lead", "extends")).alias("longest")
    chain = leads.join(stored, [*own, "lead"]).groupBy(*own, "columns").agg(longest).select(*own, "columns", "longest.lead", "longest.extends")
    extended = chain.groupBy(*own, F.col("lead").alias("columns")).agg(F.count(F.lit(1)).alias("extended_by"))
    classes = lists.join(chain.drop("lead"), [*own, "columns"], "left").join(extended, [*own, "columns"], "left")
    extended_by = F.coalesce("extended_by", F.lit(0).cast("long"))
    relationship = F.when(F.col("index_name") != F.col("representative"), "duplicate").when(extended_by > 0, "leading").otherwise("single")
    return d.join(classes, [*own, "columns"]).select(
        *keys,
        "schema_name",
        "table_name",
        "index_name",
        F.array_join("columns", ",").alias("columns"),
        "class_size",
        "representative",
        "extends",
        extended_by.alias("extended_by"),
        relationship.alias("relationship"),
    )


def index_score() -> Column:
    """100 less capped penalties for invalid, unused and duplicate indexes."""
    i, u, d = F.col("invalid_indexes"), F.col("unused_indexes"), F.col("duplicate_indexes")
    score = 100 - F.least(F.lit(30), i * 10) - F.least(F.lit(20), u * 2) - F.least(F.lit(20), d * 5)
    return F.greatest(F.lit(0), score).cast("long")


def index_health(
    indexes: DataFrame,
    tables: DataFrame,
    index_defs: DataFrame | None = None,
    schema: str = "public",
    min_size_mb: float = 0,
    include_duplicates: bool = True,
    keys: Sequence[str] = KEYS,
    advice_limit: int | None = 5,
) -> dict[str, DataFrame]:
    """Invalid, unused and duplicate indexes with a score and advice per key.

    Unused and duplicate indexes are advised on up to ``advice_limit`` each (``None``: all); counts cover all of them.
    """
    keys = list(keys)
    invalid = invalid_indexes(indexes, keys)
    unused = unused_indexes(indexes, tables, schema, min_size_mb, keys)
    out = {"invalid_indexes": invalid, "unused_indexes": unused}
    none = F.lit(0).cast("long")
    # Keys with nothing to report still get their 100.
    counted = index_facts(indexes, tables, schema, min_size_mb, keys).withColumn("duplicate_indexes", none)
    drop = [
        invalid.select(
            *keys,
            F.lit("index_health").alias("source"),
            F.lit("invalid_index").alias("rule"),
            F.lit("high").alias("severity"),
            text(F.col("schema_name"), ".", F.col("index_name")).alias("subject"),
            F.lit(None).cast("double").alias("metric"),
            text(
                "REINDEX INDEX ", F.col("schema_name"), ".", F.col("index_name"), "; -- invalid, on ", F.col("table_name")
            ).alias("message"),
        ),
        topn(unused, advice_limit, [F.desc_nulls_first("size_bytes"), F.asc("index_name")], keys).select(
            *keys,
            F.lit("index_health").alias("source"),
            F.lit("unused_index").alias("rule"),
            F.lit("medium").alias("severity"),
            F.col("index_name").alias("subject"),
            F.col("size_bytes").cast("double").alias("metric"),
            text(
                f"DROP INDEX {schema}.", F.col("index_name"), "; -- ", F.col("size"), ", unused, on ", F.col("table_name")
            ).alias("message"),
        ),
    ]
    if include_duplicates:
        dup = duplicate_indexes(index_defs, schema, keys)
        out["duplicate_indexes"] = dup
        pairs = duplicate_counts(index_defs, schema, keys).select(*keys, F.col("pairs").alias("duplicate_indexes"))
        counted = counted.unionByName(pairs, allowMissingColumns=True)
        order = [F.asc("table_name"), F.asc("index1"), F.asc("index2")]
        drop.append(
            topn(dup, advice_limit, order, keys).select(
                *keys,
                F.lit("index_health").alias("source"),
                F.col("relationship").alias("rule"),
                F.lit("medium").alias("severity"),
                F.col("index2").alias("subject"),
                F.col("size2").cast("double").alias("metric"),
                text(
                    f"DROP INDEX {schema}.",
                    F.col("index2"),
                    "; -- ",
                    F.col("relationship"),
                    " of ",
                    F.col("index1"),
                    " on ",
                    F.col("table_name"),
                ).alias("message"),
            )
        )
    out["summary"] = (
        counted.groupBy(*keys)
        .agg(*[F.sum(F.coalesce(c, none)).alias(c) for c in ("invalid_indexes", "unused_indexes", "duplicate_indexes", "potential_savings_bytes")])
        .withColumn("score", index_score())
    )
    notes = drop[0]
    for part in drop[1:]:
        notes = notes.unionByName(part)
    out["findings"] = notes
    return out
