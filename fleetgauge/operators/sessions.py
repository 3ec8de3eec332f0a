"""Sessions, connections and locks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.expressions import age_micros, age_seconds, exclude_like, left_text, older_than
from fleetgauge.functions.frames import Rule, findings, null_safe_join, text, topn, with_settings
from fleetgauge.operators.health import blocking_edges

LONG_QUERY_SECONDS = 300
IDLE_TRANSACTION_SECONDS = 60

# What makes two lock rows the same object, besides the lock type. NULLs count as equal.
LOCK_OBJECT = ("database", "relation", "page", "tuple", "virtualxid", "transactionid")
LOCK_OBJECT_FULL = (*LOCK_OBJECT, "classid", "objid", "objsubid")


def _client(df: DataFrame) -> DataFrame:
    return df.filter(F.col("backend_type") == "client backend")


def is_long_query(threshold_minutes: int = 5) -> Column:
    return (F.col("state") == "active") & older_than("snapshot_ts", "query_start", threshold_minutes * 60)


def is_idle_in_transaction(threshold_minutes: int = 1) -> Column:
    return (F.col("state") == "idle in transaction") & older_than("snapshot_ts", "xact_start", threshold_minutes * 60)


def is_long_transaction(threshold_hours: int = 1) -> Column:
    return (F.col("state") != "idle") & older_than("snapshot_ts", "xact_start", threshold_hours * 3600)


def long_running_queries(activity: DataFrame, threshold_minutes: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    age = age_seconds("snapshot_ts", "query_start").alias("duration_seconds")
    d = _client(activity).filter(is_long_query(threshold_minutes))
    return d.select(*keys, "pid", age, "usename", "datname", "state", "query")


def idle_in_transaction(activity: DataFrame, threshold_minutes: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    age = age_seconds("snapshot_ts", "xact_start").alias("transaction_seconds")
    d = _client(activity).filter(is_idle_in_transaction(threshold_minutes))
    return d.select(*keys, "pid", age, "usename", "datname", "state")


def long_running_transactions(activity: DataFrame, threshold_hours: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    age = age_seconds("snapshot_ts", "xact_start").alias("transaction_seconds")
    d = _client(activity).filter(is_long_transaction(threshold_hours))
    return d.select(*keys, "pid", "usename", "datname", "state", age, "query")


def long_running_prepared(prepared: DataFrame, threshold_hours: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    d = prepared.filter(older_than("snapshot_ts", "prepared", threshold_hours * 3600))
    age = age_seconds("snapshot_ts", "prepared").alias("duration_seconds")
    return d.select(*keys, "gid", "owner", "database", "prepared", age, "transaction")


def connection_usage(
    activity: DataFrame,
    settings: DataFrame,
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    used = activity.groupBy(*keys).agg(
        F.count_if(F.col("backend_type") == "client backend").alias("used_connections")
    )
    return with_settings(used, settings, ["max_connections"], keys, settings_keys).select(
        *keys, "used_connections", F.col("max_connections").cast("long").alias("max_connections")
    )


def _lock_facts(locks: DataFrame, activity: DataFrame, objects: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Lock rows whose session is known, with the session's facts."""
    facts = activity.select(*keys, "pid", "usename", "query", "query_start")
    cols = [c for c in objects if c in locks.columns]
    return locks.select(*keys, "pid", "locktype", *cols, "mode", "granted").join(facts, [*keys, "pid"])


def lock_waiters(
    locks: DataFrame, activity: DataFrame, limit: int = 20, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The first ``limit`` (waiter, holder) pairs per key, by waiting pid.

    A hot object would pair every waiter with every holder. The limit is met exactly without that:
    of one object only its first ``limit`` waiters can be among the first pairs, each has a pair as
    soon as a second session is on the object, and ``limit`` + 1 lowest other pids are partners
    enough (one may be the waiter itself). So both sides are cut per object before they are paired.
    """
    keys = list(keys)
    lk = _lock_facts(locks, activity, LOCK_OBJECT, keys)
    obj = [*keys, "locktype", *LOCK_OBJECT]
    waiters = topn(lk.filter(~F.col("granted")), limit, [F.asc("pid"), F.asc("mode")], obj)
    by_pid = F.dense_rank().over(Window.partitionBy(*obj).orderBy("pid"))
    others = lk.withColumn("_r", by_pid).filter(F.col("_r") <= limit + 1).drop("_r")
    w = waiters.select(
        *obj,
        F.col("pid").alias("blocked_pid"),
        F.col("usename").alias("blocked_user"),
        F.col("query").alias("blocked_query"),
        F.col("mode").alias("blocked_mode"),
    )
    o = others.select(
        *obj,
        F.col("pid").alias("blocking_pid"),
        F.col("usename").alias("blocking_user"),
        F.col("query").alias("blocking_query"),
        F.col("mode").alias("_blocking_mode"),
    )
    pairs = (
        null_safe_join(w, o, obj)
        .filter(F.col("blocked_pid") != F.col("blocking_pid"))
        .select(
            *keys,
            "blocked_pid",
            "blocked_user",
            "blocked_query",
            "blocking_pid",
            "blocking_user",
            "blocking_query",
            "blocked_mode",
            "_blocking_mode",
            F.col("relation").alias("blocked_relation"),
        )
    )
    order = [F.asc("blocked_pid"), F.asc("blocking_pid"), F.asc("blocked_mode"), F.asc("_blocking_mode")]
    return topn(pairs, limit, order, keys).drop("_blocking_mode")


def lock_wait_graph(locks: DataFrame, activity: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every lock that shares its object with another session, and how many locks stand against it.

    The documented pair list grows with the square of an object's locks. This is the same relation
    with the pairs counted instead of written out: ``object_locks`` less the session's own locks on
    the object is the number of pair rows of that lock. The members of one object carry the same
    ``object_id``, so any pair list can be produced from it by joining on that column.
    """
    keys = list(keys)
    objects = [c for c in LOCK_OBJECT_FULL if c in locks.columns]
    lk = _lock_facts(locks, activity, objects, keys)
    obj = [*keys, "locktype", *objects]
    per_pid = lk.groupBy(*obj, "pid").agg(F.count(F.lit(1)).alias("own"))
    per_object = per_pid.groupBy(*obj).agg(F.sum("own").alias("object_locks"), F.count(F.lit(1)).alias("sessions"))
    shared = per_object.filter(F.col("sessions") > 1)
    both = null_safe_join(lk, shared, obj)
    # A session with several locks on one object must not count its own.
    many = per_pid.filter(F.col("own") > 1)
    label = F.concat_ws("/", "locktype", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in objects])
    return null_safe_join(both, many, [*obj, "pid"], "left").select(
        *keys,
        F.col("pid").alias("blocked_pid"),
        F.col("usename").alias("blocked_user"),
        F.col("query").alias("blocked_query"),
        F.col("query_start").alias("blocked_since"),
        F.col("mode").alias("blocked_mode"),
        "granted",
        (F.col("sessions") - 1).alias("blocking_sessions"),
        (F.col("object_locks") - F.coalesce("own", F.lit(1).cast("long"))).alias("blocking_locks"),
        label.alias("object_id"),
    )


def active_sessions(
    activity: DataFrame,
    min_duration_seconds: int = 0,
    include_idle: bool = False,
    include_system: bool = False,
    database: str | None = None,
    keys: Sequence[str] = KEYS,
    query_chars: int | None = 500,
) -> DataFrame:
    """Sessions with their ages; ``query_chars`` cuts the statement text, ``None`` leaves it whole."""
    d = activity
    if not include_idle:
        d = d.filter(F.col("state") != "idle")
    if not include_system:
        d = _client(d).filter(exclude_like("query", ("%pg_catalog%", "%information_schema%")))
    if database:
        d = d.filter(F.col("datname") == database)
    if min_duration_seconds > 0:
        d = d.filter(age_micros("snapshot_ts", "query_start") >= min_duration_seconds * 1_000_000)
    return d.select(
        *keys,
        "pid",
        F.col("datname").alias("database"),
        F.col("usename").alias("username"),
        "client_addr",
        "state",
        "wait_event_type",
        "wait_event",
        age_seconds("snapshot_ts", "query_start").alias("duration_seconds"),
        age_seconds("snapshot_ts", "xact_start").alias("transaction_seconds"),
        ("query" if query_chars is None else left_text("query", query_chars).alias("query")),
        "backend_type",
    )


def sessions_by_state(activity: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _client(activity).groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("count"))


def blocked_sessions(
    activity: DataFrame, edges: DataFrame | None = None, limit: int | None = 10, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Blocked and blocking session pairs of sessions that wait for a lock, each pair once; ``limit`` of a key, ``None`` for all."""
    keys = list(keys)
    edges = blocking_edges(activity, keys) if edges is None else edges.select(*keys, "pid", "blocking_pid").distinct()
    blocked = activity.filter(F.col("wait_event_type") == "Lock").select(
        *keys, "pid", F.col("query").alias("blocked_query"), "wait_event_type", "wait_event"
    )
    blocking = activity.select(
        *keys, F.col("pid").alias("blocking_pid"), F.col("query").alias("blocking_query")
    )
    pairs = (
        blocked.join(edges, [*keys, "pid"])
        .withColumnRenamed("pid", "blocked_pid")
        .join(blocking, [*keys, "blocking_pid"])
        .select(
            *keys, "blocked_pid", "blocked_query", "blocking_pid", "blocking_query", "wait_event_type", "wait_event"
        )
    )
    return topn(pairs, limit, [F.asc("blocked_pid"), F.asc("blocking_pid")], keys)


def session_findings(active: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    pid, run, tx = F.col("pid"), F.col("duration_seconds"), F.col("transaction_seconds")
    idle = (F.col("state") == "idle in transaction") & (tx > IDLE_TRANSACTION_SECONDS)
    return findings(
        active,
        "active_queries",
        [
            Rule("long_query", run > LONG_QUERY_SECONDS, "warning", pid, run, text("pid ", pid, " runs for ", run, "s")),
            Rule(
                "idle_transaction", idle, "warning", pid, tx, text("pid ", pid, " idle in transaction for ", tx, "s")
            ),
        ],
        keys,
    )


def active_queries(
    activity: DataFrame,
    edges: DataFrame | None = None,
    min_duration_seconds: int = 0,
    include_idle: bool = False,
    include_system: bool = False,
    database: str | None = None,
    keys: Sequence[str] = KEYS,
    blocked_limit: int | None = 10,
    query_chars: int | None = 500,
) -> dict[str, DataFrame]:
    """Session detail, counts by state (independent of the filters), blocked pairs, findings.

    ``blocked_limit`` cuts the pairs of a key and ``query_chars`` the statement texts (``None``: all).
    """
    detail = active_sessions(activity, min_duration_seconds, include_idle, include_system, database, keys, query_chars)
    return {
        "active_queries": detail,
        "by_state": sessions_by_state(activity, keys),
        "total_connections": detail.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_connections")),
        "blocked_queries": blocked_sessions(activity, edges, blocked_limit, keys),
        "findings": session_findings(detail, keys),
    }
