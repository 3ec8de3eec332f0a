"""Replication and log archiving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.expressions import age_micros, lsn_diff, size_pretty
from fleetgauge.functions.frames import keyed_join


def replication_slots(slots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Slots with the log bytes they hold back."""
    lag = lsn_diff("current_lsn", "restart_lsn").alias("restart_lsn_lag_bytes")
    return slots.select(*keys, "slot_name", "plugin", "slot_type", "database", "active", lag)


def replication_status(replication: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return replication.select(
        *keys,
        "application_name",
        "client_addr",
        "state",
        "sync_state",
        "sync_priority",
        lsn_diff("current_lsn", "sent_lsn").alias("sent_lag_bytes"),
        lsn_diff("flush_lsn", "replay_lsn").alias("replay_lag_bytes"),
        *[F.col(c).cast("string").alias(f"{c}_time") for c in ("write_lag", "flush_lag", "replay_lag")],
    )


def logical_replication_status(subscriptions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Seconds since the last message was sent and received, per enabled subscription."""
    second = F.lit(1_000_000.0)
    return subscriptions.filter(F.col("subid").isNotNull()).select(
        *keys,
        "subname",
        "subid",
        (age_micros("snapshot_ts", "last_msg_send_time") / second).alias("send_lag_sec"),
        (age_micros("snapshot_ts", "last_msg_receipt_time") / second).alias("receive_lag_sec"),
    )


def wal_archiver_status(
    archiver: DataFrame,
    wal_files: DataFrame,
    databases: DataFrame | None = None,
    database: str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Archiver counters beside the size of the log directory.

    Without any file size the directory is estimated as a tenth of the database.
    """
    keys = list(keys)
    files = wal_files.groupBy(*keys).agg(F.sum("size").alias("_wal_files_bytes"))
    out = keyed_join(archiver, files, keys, "left")
    size = F.col("_wal_files_bytes")
    if databases is not None:
        d = databases if database is None else databases.filter(F.col("datname") == database)
        sizes = d.groupBy(*keys).agg(F.sum("size_bytes").alias("_database_bytes"))
        out = keyed_join(out, sizes, keys, "left")
        size = F.coalesce(size, F.round(F.col("_database_bytes") / F.lit(10.0)).cast("long"))
    cols = [
        "archived_count",
        "last_archived_wal",
        "last_archived_time",
        "failed_count",
        "last_failed_wal",
        "last_failed_time",
        "stats_reset",
    ]
    return out.select(
        *keys,
        *[c for c in cols if c in archiver.columns],
        size.alias("wal_directory_bytes"),
        size_pretty(size).alias("wal_directory_size"),
    )
