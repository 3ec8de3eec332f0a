"""Performance baselines: one long metric table over the main reports, and comparisons of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.expressions import hit_ratio, lsn_diff, round_exact, zero_as_missing
from fleetgauge.functions.frames import interval_deltas
from fleetgauge.operators.health import (
    TEMPLATE_DATABASES,
    bgwriter_facts,
    blocked_session,
    checks_of_facts,
    duplicate_counts,
    health_check,
    index_facts,
    index_health,
    index_score,
    wait_events,
)
from fleetgauge.operators.maintenance import BLOCK_SIZE, database_sizes, top_objects_by_size
from fleetgauge.operators.performance import (
    POOL_COUNTERS,
    disk_io_analysis,
    heap_ratio,
    io_candidates,
    physical_reads,
    pool_ratios,
    scan_ratio,
    table_report,
    top_statements,
)
from fleetgauge.operators.replication import replication_status

# Section, how an item of it is named, and the numbers it contributes.
SECTIONS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "health": ((), ("overall_score",)),
    "health_checks": (("check_name",), ("score", "metric")),
    "statements": (("queryid",), ("calls", "mean_time_ms", "rows", "cache_hit_ratio")),
    "tables": (
        ("schema_name", "table_name"),
        ("total_size_bytes", "n_live_tup", "n_dead_tup", "dead_tuple_ratio", "seq_scan", "index_scan_ratio"),
    ),
    "buffer_pool": ((), ("heap_hit_ratio", "index_hit_ratio")),
    "table_io": (("table_name",), ("total_physical_reads", "heap_hit_ratio", "seq_scan_ratio")),
    "index_io": (("index_name",), ("blocks_read", "hit_ratio")),
    "index_health": ((), ("score", "invalid_indexes", "unused_indexes", "potential_savings_bytes")),
    "wait_events": (("wait_event_type",), ("count",)),
    "databases": (("datname",), ("size_bytes",)),
    "objects": (("type", "schemaname", "object_name"), ("size_bytes",)),
    "replication": (("application_name",), ("sent_lag_bytes", "replay_lag_bytes")),
}


def baseline_report(t: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> dict[str, DataFrame]:
    """The fixed set of reports of a baseline, lazily, from the telemetry tables."""
    health = health_check(
        t["activity"], t["tables"], t["locks"], t["replication"], t["databases"], t["bgwriter"], t["settings"], keys=keys
    )
    io = disk_io_analysis(t["tables"], t["indexes"], keys=keys)
    return {
        "health": health["overall"],
        "health_checks": health["checks"],
        "statements": top_statements(t["statements"], limit=20, keys=keys),
        "tables": table_report(t["tables"], keys=keys),
        "buffer_pool": io["buffer_pool"],
        "table_io": io["tables"],
        "index_io": io["indexes"],
        "index_health": index_health(t["indexes"], t["tables"], t.get("index_defs"), keys=keys, include_duplicates="index_defs" in t)[
            "summary"
        ],
        "wait_events": wait_events(t["activity"], active_only=False, keys=keys)["by_type"],
        "databases": database_sizes(t["databases"], keys=keys),
        "objects": top_objects_by_size(t["tables"], t["indexes"], keys=keys),
        "replication": replication_status(t["replication"], keys=keys),
    }


def baseline_metrics(report: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """All sections of a report as (key, section, item, metric, value) rows."""
    out = None
    for section, df in report.items():
        names, numbers = SECTIONS[section]
        item = F.concat_ws(".", *[F.col(n).cast("string") for n in names]) if names else F.lit("all")
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in numbers])
        part = df.select(*keys, F.lit(section).alias("section"), item.alias("item"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out


#: Top lists of a baseline: section, and how many of a key.
_LISTS = {"table_reads": 20, "table_scans": 20, "index_io": 20, "databases": 10, "tables_by_size": 5, "indexes_by_size": 5}
_MOST = max(_LISTS.values())


def _entry(name: str, when: Column, item: Column, by: Column, ties: Sequence[str], *values: Column) -> Column:
    """An entry of a top list: ranked by a number, largest (and unknown) first, then by names."""
    first, second = [*[F.col(t) for t in ties], F.lit("")][:2]
    numbers = F.array(*[v.cast("double") for v in values])
    return F.when(
        when,
        F.struct(F.lit(name).alias("list"), item.alias("item"), by.cast("decimal(38,6)").alias("by"), first.alias("tie"), second.alias("tie2"), numbers.alias("numbers")),
    )


def _entries(df: DataFrame, keys: Sequence[str], *entries: Column) -> DataFrame:
    return df.select(*keys, F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def _facts(t: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """What every table adds to the sums of a key, side by side, one row per row of a table; ``_wait`` tells waits apart."""
    one = F.lit(1).cast("long")
    activity, own = t["activity"], ~F.col("datname").isin(*TEMPLATE_DATABASES)
    waiting = (F.col("backend_type") == "client backend") & F.col("wait_event_type").isNotNull()
    lag = F.coalesce(lsn_diff("sent_lsn", "replay_lsn"), F.lit(0).cast("long"))
    parts = [
        activity.select(*keys, "wait_event_type", F.when(waiting, one).alias("waits"), one.alias("used"), blocked_session().cast("long").alias("blocking_queries")),
        t["locks"].select(*keys, (~F.col("granted")).cast("long").alias("waiting_locks")),
        t["tables"].select(*keys, one.alias("tables"), *POOL_COUNTERS),
        t["replication"].select(*keys, one.alias("replicas"), lag.alias("lag")),
        t["databases"].select(
            *keys,
            one.alias("any_database"),
            F.when(own, one).otherwise(0).alias("databases"),
            F.when(own, F.col("xid_age")).alias("xid_age"),
            F.when(own, F.col("size_bytes")).alias("total_size"),
        ),
        bgwriter_facts(t["bgwriter"], keys),
        index_facts(t["indexes"], t["tables"], keys=keys),
    ]
    if "index_defs" in t:
        parts.append(duplicate_counts(t["index_defs"], keys=keys).select(*keys, F.col("pairs").alias("duplicate_indexes")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out if "index_defs" in t else out.withColumn("duplicate_indexes", F.lit(None).cast("long"))


_LARGEST = ("lag", "xid_age", "checkpoints_timed", "checkpoints_req", "buffers_checkpoint", "buffers_clean", "buffers_backend", "reset_micros")


def baseline_pass(t: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """:func:`baseline_metrics` of :func:`baseline_report`, with the work of all sections fused.

    All sums of a key come from one aggregate over all tables, partial in every task before anything is moved; all top lists come from
    one ranking, cut to the list's length before the shuffle. Each table is read once for its sums and once for its lists.
    """
    keys = list(keys)
    rows = _facts(t, keys)
    measures = [c for c in rows.columns if c not in (*keys, "wait_event_type")]

    by_wait = rows.groupBy(*keys, "wait_event_type").agg(*[(F.max(c) if c in _LARGEST else F.sum(c)).alias(c) for c in measures])
    # There are about ten types of waits.
    kinds = F.collect_list(F.when(F.col("waits") > 0, F.struct("wait_event_type", "waits"))).alias("kinds")
    facts = by_wait.groupBy(*keys).agg(*[(F.max(c) if c in _LARGEST else F.sum(c)).alias(c) for c in measures], kinds)
    zero = F.lit(0).cast("long")
    counts = ("invalid_indexes", "unused_indexes", "duplicate_indexes", "potential_savings_bytes")
    facts = facts.withColumns({c: F.coalesce(c, zero) for c in counts})

    def cells(section: str, item: Column, **numbers: Column) -> Column:
        made = [F.struct(F.lit(section).alias("section"), item.alias("item"), F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in numbers.items()]
        return F.array(*made)

    checks = checks_of_facts(facts, t["settings"], keys)
    whole = F.lit("all")
    scores = F.aggregate("checks", zero, lambda total, c: total + c["score"])
    overall = round_exact(scores / F.size("checks"), 1)
    each = F.flatten(F.transform("checks", lambda c: cells("health_checks", c["check_name"], score=c["score"], metric=c["metric"])))
    pool = pool_ratios()
    top = _entries(
        t["tables"],
        keys,
        _entry("tables_by_size", F.lit(True), F.concat_ws(".", F.lit("table"), "schemaname", "relname"), F.col("relpages"), ("schemaname", "relname"), F.col("relpages") * F.lit(BLOCK_SIZE)),
        _entry("table_reads", io_candidates("total_size_bytes"), F.col("relname"), physical_reads(), ("relname",), F.coalesce(physical_reads(), zero), heap_ratio()),
        _entry("table_scans", io_candidates("total_size_bytes"), F.col("relname"), F.col("seq_tup_read"), ("relname",), scan_ratio()),
    )
    index_blocks = zero_as_missing(hit_ratio("idx_blks_hit", "idx_blks_read"), 100, True)
    top = top.unionByName(
        _entries(
            t["indexes"],
            keys,
            _entry("indexes_by_size", F.lit(True), F.concat_ws(".", F.lit("index"), "schemaname", "index_name"), F.col("relpages"), ("schemaname", "index_name"), F.col("relpages") * F.lit(BLOCK_SIZE)),
            _entry("index_io", io_candidates("size_bytes"), F.col("index_name"), F.col("idx_blks_read"), ("index_name",), F.coalesce("idx_blks_read", zero), index_blocks),
        )
    ).unionByName(_entries(t["databases"], keys, _entry("databases", ~F.col("datistemplate"), F.col("datname"), F.col("size_bytes"), ("datname",), F.col("size_bytes"))))
    ranked = F.row_number().over(Window.partitionBy(*keys, "list").orderBy(F.desc_nulls_first("by"), F.asc("tie"), F.asc("tie2")))
    limit = F.create_map(*[x for name, n in _LISTS.items() for x in (F.lit(name), F.lit(n))])[F.col("list")]
    top = top.withColumn("_rank", ranked).filter(F.col("_rank") <= _MOST).filter(F.col("_rank") <= limit)
    # A table's reads and scans are two entries of one item.
    section = F.when(F.col("list").isin("table_reads", "table_scans"), "table_io").when(F.col("list").endswith("_by_size"), "objects").otherwise(F.col("list"))
    top = top.withColumn("section", section).groupBy(*keys, "section", "item").agg(
        F.max(F.when(F.col("list") != "table_scans", F.col("numbers"))).alias("numbers"), F.max(F.when(F.col("list") == "table_scans", F.col("numbers"))).alias("scans")
    )
    top = top.filter("numbers is not null").withColumn("numbers", F.when(F.col("section") == "table_io", F.concat("numbers", F.coalesce("scans", F.array(F.lit(0.0))))).otherwise(F.col("numbers")))
    metrics = F.create_map(*[x for name, (_, numbers) in SECTIONS.items() for x in (F.lit(name), F.array(*[F.lit(m) for m in numbers]))])[F.col("section")]
    pairs_of = F.transform(F.arrays_zip(metrics.alias("m"), F.col("numbers").alias("n")), lambda z: F.struct(z["m"].alias("metric"), z["n"].alias("value")))
    replicas, reports = replication_status(t["replication"], keys=keys), table_report(t["tables"], keys=keys)

    def rowwise(df: DataFrame, name: str) -> DataFrame:
        names, numbers = SECTIONS[name]
        item = F.concat_ws(".", *[F.col(n).cast("string") for n in names])
        return df.select(*keys, F.inline(cells(name, item, **{m: F.col(m) for m in numbers})))

    def present(when: Column, made: Column) -> Column:
        return F.filter(made, lambda _: F.coalesce(when, F.lit(False)))

    waits = F.flatten(F.transform("kinds", lambda w: cells("wait_events", w["wait_event_type"], count=w["waits"])))
    indexes = {m: F.col(m) if m in counts else index_score() for m in SECTIONS["index_health"][1]}
    sections = F.concat(
        present(F.size("checks") > 0, cells("health", whole, overall_score=overall)),
        each,
        present(F.col("tables") > 0, cells("buffer_pool", whole, heap_hit_ratio=pool[0], index_hit_ratio=pool[1])),
        waits,
        present((F.col("indexes") > 0) | (F.col("duplicate_indexes") > 0), cells("index_health", whole, **indexes)),
    )
    parts = [
        checks.select(*keys, F.inline(sections)),
        top.select(*keys, "section", "item", F.inline(pairs_of)),
        rowwise(top_statements(t["statements"], limit=_MOST, keys=keys), "statements"),
        rowwise(reports, "tables"),
        rowwise(replicas, "replication"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def baseline_diff(
    before: DataFrame, after: DataFrame, id_cols: Sequence[str], metric_cols: Sequence[str]
) -> DataFrame:
    """Two baselines side by side: rows only in one, and the difference of every metric.

    Ids are unique on each side. A metric missing on both sides counts as unchanged.
    """
    ids = list(id_cols)
    b = before.select(*ids, F.lit(True).alias("_b"), *[F.col(m).alias(f"{m}_before") for m in metric_cols])
    a = after.select(*ids, F.lit(True).alias("_a"), *[F.col(m).alias(f"{m}_after") for m in metric_cols])
    d = b.join(a, ids, "full")

    def same(m: str) -> Column:
        return F.col(f"{m}_before").eqNullSafe(F.col(f"{m}_after"))

    unchanged = F.lit(True)
    for m in metric_cols:
        unchanged = unchanged & same(m)
    state = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when(unchanged, "same")
        .otherwise("changed")
    )
    cells: list[Column] = []
    for m in metric_cols:
        old, new = F.col(f"{m}_before"), F.col(f"{m}_after")
        cells += [old, new, (new - old).alias(f"{m}_delta")]
    return d.select(*ids, state.alias("change"), *cells)


def consecutive_diff(
    df: DataFrame, id_cols: Sequence[str], counters: Sequence[str], bucket: str = "day"
) -> DataFrame:
    """Growth of counters between consecutive snapshots of each series, resets respected."""
    return interval_deltas(df, id_cols, counters, bucket=bucket)
