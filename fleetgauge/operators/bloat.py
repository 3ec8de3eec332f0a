"""Scoring of collected table and index page samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.expressions import (
    band,
    fixed_text,
    format_bytes,
    gb_to_bytes,
    not_system_schema,
    round_exact,
    zero_as_missing,
)
from fleetgauge.functions.frames import Rule, findings, first_names, text, topn


def _num(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def table_bloat_severity(dead: Column, free: Column, density: Column) -> dict[str, Column]:
    """Status per dimension and the overall severity of their points."""
    # Thresholds and points.
    dead_status = band(dead, [(">", 30, "critical"), (">", 10, "warning")], "normal")
    free_status = band(free, [(">", 30, "critical"), (">", 20, "warning")], "normal")
    density_status = band(density, [("<", 50, "critical"), ("<", 70, "warning")], "normal")
    points = (
        band(dead, [(">", 30, 3), (">", 10, 2)], 0)
        + band(free, [(">", 30, 3), (">", 20, 2)], 0)
        + band(density, [("<", 50, 3), ("<", 70, 2)], 0)
    )
    overall = band(points, [(">=", 6, "critical"), (">=", 4, "high"), (">=", 2, "moderate"), (">=", 1, "low")], "minimal")
    return {
        "bloat_severity": overall,
        "dead_tuple_status": dead_status,
        "free_space_status": free_status,
        "tuple_density_status": density_status,
    }


def bloat_metrics(samples: DataFrame, use_approx: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wasted space and severity of every sampled table, from the exact or the approximate fields."""
    prefix = "approx_" if use_approx else ""
    length = _num("table_len")
    dead_len, free_len = _num("dead_tuple_len"), _num(f"{prefix}free_space")
    dead, free, density = _num("dead_tuple_percent"), _num(f"{prefix}free_percent"), _num(f"{prefix}tuple_percent")
    wasted = dead_len + free_len
    wasted_pct = F.when(length > 0, round_exact(F.lit(100.0) * wasted / length, 2)).otherwise(F.lit(0.0))
    extra = [_num("scanned_percent").alias("scanned_percent")] if use_approx else []
    return samples.select(
        *keys,
        F.col("schemaname").alias("schema_name"),
        F.col("relname").alias("table_name"),
        F.lit("approximate" if use_approx else "exact").alias("analysis_type"),
        *extra,
        length.alias("table_len_bytes"),
        format_bytes(length).alias("table_len_pretty"),
        _num(f"{prefix}tuple_count").alias("live_tuple_count"),
        _num(f"{prefix}tuple_len").alias("live_tuple_len"),
        density.alias("tuple_percent"),
        _num("dead_tuple_count").alias("dead_tuple_count"),
        dead_len.alias("dead_tuple_len"),
        dead.alias("dead_tuple_percent"),
        free_len.alias("free_space_bytes"),
        format_bytes(free_len).alias("free_space_pretty"),
        free.alias("free_percent"),
        wasted.alias("wasted_space_bytes"),
        format_bytes(wasted).alias("wasted_space_pretty"),
        wasted_pct.alias("wasted_percent"),
        *[c.alias(n) for n, c in table_bloat_severity(dead, free, density).items()],
    )


def table_bloat_findings(metrics: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Advice per table; a table without any gets one row saying so."""
    dead, free, density = F.col("dead_tuple_percent"), F.col("free_percent"), F.col("tuple_percent")
    name = text(F.col("schema_name"), ".", F.col("table_name"))
    thin = (density > 0) & (density < 50)
    thinner = (density > 0) & (density >= 50) & (density < 70)
    any_rule = (dead > 10) | (free > 20) | thin | thinner
    sound = (dead < 10) & (free <= 20) & (density >= 70)

    def rule(rule_name: str, when: Column, severity: str, metric: Column, *message: Column | str) -> Rule:
        return Rule(rule_name, when, severity, name, metric, text(*message))

    rules = [
        rule("dead_critical", dead > 30, "critical", dead, "dead rows ", fixed_text(dead, 1), "%: VACUUM ANALYZE ", name),
        rule("dead_tuning", dead > 30, "advice", dead, "lower autovacuum_vacuum_scale_factor of ", name),
        rule("dead_warning", (dead > 10) & (dead <= 30), "warning", dead, "dead rows ", fixed_text(dead, 1), "%: tune ", name),
        rule("free_critical", free > 30, "critical", free, "free space ", fixed_text(free, 1), "%: rewrite ", name),
        rule(
            "free_warning",
            (free > 20) & (free <= 30),
            "warning",
            free,
            "free space ",
            fixed_text(free, 1),
            "%: plan a rewrite of ",
            name,
        ),
        rule("density_critical", thin, "critical", density, "live data ", fixed_text(density, 1), "%: VACUUM FULL ", name),
        rule("density_warning", thinner, "warning", density, "live data ", fixed_text(density, 1), "%: heavy bloat in ", name),
        rule("healthy", ~any_rule & sound, "ok", density, name, " is healthy"),
        rule("minimal", ~any_rule & ~sound, "ok", density, name, " has minimal bloat"),
    ]
    return findings(metrics, "table_bloat", rules, keys)


def bloat_rollup(tables: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Advice over the reported tables of a key: how many, and the first names by wasted space."""
    order = [F.desc("wasted_space_bytes"), F.asc("table_name")]
    density = F.col("tuple_percent")
    groups = [
        ("critical_tables", "critical", F.col("bloat_severity") == "critical", " tables with critical bloat"),
        ("high_tables", "high", F.col("bloat_severity") == "high", " tables with high bloat"),
        ("dead_over_10", "warning", F.col("dead_tuple_percent") > 10, " tables above 10% dead rows"),
        ("free_over_20", "warning", F.col("free_percent") > 20, " tables above 20% free space"),
        ("density_under_70", "warning", (density > 0) & (density < 70), " tables below 70% live data"),
    ]
    return _rollup(tables, "table_bloat", "table_name", groups, order, keys)


def _rollup(
    rows: DataFrame,
    source: str,
    name: str,
    groups: Sequence[tuple[str, str, Column, str]],
    order: Sequence[Column],
    keys: Sequence[str],
) -> DataFrame:
    # All groups in one pass: a row joins every group it belongs to, then each group is cut to names.
    cells = F.array(*[F.when(when, F.struct(F.lit(i).alias("g"))) for i, (_, _, when, _) in enumerate(groups)])
    hits = rows.select(*rows.columns, F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("_g"))
    hits = hits.withColumn("_g", F.col("_g.g"))
    d = first_names(hits, name, order, [*keys, "_g"])
    rule, severity, message = F.lit(None), F.lit(None), F.lit(None)
    for i, (rule_name, level, _, what) in enumerate(groups):
        here = F.col("_g") == i
        rule = F.when(here, rule_name).otherwise(rule)
        severity = F.when(here, level).otherwise(severity)
        message = F.when(here, text(F.col("n"), what)).otherwise(message)
    return d.select(
        *keys,
        F.lit(source).alias("source"),
        rule.alias("rule"),
        severity.alias("severity"),
        F.col("names").alias("subject"),
        F.col("n").cast("double").alias("metric"),
        message.alias("message"),
    )


def toast_bloat(samples: DataFrame, tables: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The sample of each table's out-of-line storage, where it was collected."""
    owners = tables.filter(F.col("toast_relname").isNotNull()).select(
        *keys, "schemaname", "relname", F.col("toast_relname"), "toast_size_bytes"
    )
    facts = [c for c in ("table_len", "tuple_percent", "dead_tuple_percent", "free_percent") if c in samples.columns]
    toast = samples.filter(F.col("schemaname") == "pg_toast").select(
        *keys, F.col("relname").alias("toast_relname"), *facts
    )
    return owners.join(toast, [*keys, "toast_relname"]).select(
        *keys,
        F.col("schemaname").alias("schema_name"),
        F.col("relname").alias("table_name"),
        F.col("toast_relname").alias("toast_table_name"),
        F.col("toast_size_bytes").alias("toast_size"),
        format_bytes("toast_size_bytes").alias("toast_size_pretty"),
        *facts,
    )


def table_bloat(
    samples: DataFrame,
    tables: DataFrame | None = None,
    table: str | None = None,
    schema: str = "public",
    use_approx: bool = False,
    min_table_size_gb: float = 5,
    include_toast: bool = False,
    min_bloat_percent: float = 20,
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    """Bloat of one table, or of all tables of a schema from a given size on.

    The totals cover every sampled table of that size; the reported rows, and their count, only
    those from the given share of wasted space on.
    """
    keys = list(keys)
    sampled = samples.filter(F.col("schemaname") == schema)
    if table:
        metrics = bloat_metrics(sampled.filter(F.col("relname") == table), use_approx, keys)
        out = {"tables": metrics, "findings": table_bloat_findings(metrics, keys)}
        if include_toast and tables is not None:
            owner = tables.filter((F.col("schemaname") == schema) & (F.col("relname") == table))
            out["toast"] = toast_bloat(samples, owner, keys)
        return out
    sampled = sampled.filter(not_system_schema("schemaname") & (F.col("table_len") >= gb_to_bytes(min_table_size_gb)))
    metrics = bloat_metrics(sampled, use_approx, keys)
    reported = F.col("wasted_percent") >= min_bloat_percent if min_bloat_percent > 0 else F.lit(True)
    shown = metrics.filter(reported)
    size, wasted = F.col("total_table_size"), F.col("total_wasted_space")
    summary = (
        metrics.groupBy(*keys)
        .agg(
            F.count_if(reported).alias("tables_analyzed"),
            F.sum("table_len_bytes").alias("total_table_size"),
            F.sum("wasted_space_bytes").alias("total_wasted_space"),
        )
        .select(
            *keys,
            "tables_analyzed",
            "total_table_size",
            format_bytes("total_table_size").alias("total_table_size_pretty"),
            "total_wasted_space",
            format_bytes("total_wasted_space").alias("total_wasted_space_pretty"),
            F.when(size > 0, round_exact(F.lit(100.0) * wasted / size, 2)).otherwise(0.0).alias("overall_wasted_percent"),
        )
    )
    return {"tables": shown, "summary": summary, "findings": bloat_rollup(shown, keys)}


# --- indexes ------------------------------------------------------------------------------------


def index_bloat_severity(density: Column, free: Column) -> dict[str, Column]:
    # Thresholds and points.
    points = band(density, [("<", 50, 3), ("<", 70, 2)], 0) + band(free, [(">", 30, 2), (">", 20, 1)], 0)
    bloat = F.greatest(F.lit(0.0), F.lit(90.0) - density)
    overall = (
        F.when((points >= 4) | (bloat >= 40), "critical")
        .when((points >= 3) | (bloat >= 30), "high")
        .when((points >= 2) | (bloat >= 20), "moderate")
        .otherwise("low")
    )
    return {
        "estimated_bloat_percent": round_exact(bloat, 2),
        "bloat_severity": overall,
        "density_status": band(density, [("<", 50, "critical"), ("<", 70, "warning")], "normal"),
    }


def btree_stats(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """B-tree page figures; a missing or zero density counts as 90, missing leaf pages as 1."""
    d = samples.filter(F.col("access_method") == "btree")
    density = zero_as_missing(F.col("avg_leaf_density").cast("double"), 90)
    leaf = F.coalesce(F.nullif("leaf_pages", F.lit(0).cast("long")), F.lit(1).cast("long"))
    empty, deleted = _num("empty_pages"), _num("deleted_pages")
    free = round_exact(F.lit(100.0) * (empty + deleted) / leaf, 2)
    staged = d.withColumns({"_density": density, "_free": free})
    return staged.select(
        *keys,
        F.col("schemaname").alias("schema_name"),
        F.col("relname").alias("table_name"),
        "index_name",
        F.col("access_method").alias("index_type"),
        F.col("size_bytes").alias("index_size"),
        leaf.alias("leaf_pages"),
        empty.alias("empty_pages"),
        deleted.alias("deleted_pages"),
        F.col("_density").alias("avg_leaf_density"),
        "leaf_fragmentation",
        F.col("_free").alias("free_percent"),
        *[c.alias(n) for n, c in index_bloat_severity(F.col("_density"), F.col("_free")).items()],
    )


def gin_stats(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return samples.filter(F.col("access_method") == "gin").select(
        *keys,
        F.col("schemaname").alias("schema_name"),
        F.col("relname").alias("table_name"),
        "index_name",
        F.col("size_bytes").alias("index_size"),
        "pending_pages",
        "pending_tuples",
    )


def hash_stats(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return samples.filter(F.col("access_method") == "hash").select(
        *keys,
        F.col("schemaname").alias("schema_name"),
        F.col("relname").alias("table_name"),
        "index_name",
        F.col("size_bytes").alias("index_size"),
        "bucket_pages",
        "overflow_pages",
        "bitmap_pages",
        "unused_pages",
        "live_items",
        "dead_items",
        "hash_free_percent",
    )


def index_stats(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All sampled indexes with the figures of their access method; the rest NULL."""
    out = btree_stats(samples, keys)
    for part in (gin_stats(samples, keys), hash_stats(samples, keys)):
        kind = "gin" if "pending_tuples" in part.columns else "hash"
        out = out.unionByName(part.withColumn("index_type", F.lit(kind)), allowMissingColumns=True)
    other = samples.filter(~F.col("access_method").isin("btree", "gin", "hash")).select(
        *keys,
        F.col("schemaname").alias("schema_name"),
        F.col("relname").alias("table_name"),
        "index_name",
        F.col("access_method").alias("index_type"),
        F.col("size_bytes").alias("index_size"),
    )
    return out.unionByName(other, allowMissingColumns=True)


def index_bloat_findings(stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    btree, gin, hashed = [F.col("index_type") == t for t in ("btree", "gin", "hash")]
    density, free, frag = F.col("avg_leaf_density"), F.col("free_percent"), F.col("leaf_fragmentation")
    deleted, pending, dead = F.col("deleted_pages"), F.col("pending_tuples"), F.col("dead_items")
    name = text(F.col("schema_name"), ".", F.col("index_name"))
    low, lower = btree & (density < 50), btree & (density >= 50) & (density < 70)
    roomy, roomier = btree & (free > 20) & (free <= 30), btree & (free > 30)
    split = btree & F.coalesce(frag > 30, F.lit(False))
    cleared = btree & (deleted > 10)
    none = btree & ~(low | lower | roomy | roomier | split | cleared)

    def rule(rule_name: str, when: Column, severity: str, metric: Column, *message: Column | str) -> Rule:
        return Rule(rule_name, when, severity, name, metric, text(*message))

    rules = [
        rule("density_critical", low, "critical", density, "leaf density ", fixed_text(density, 1), "%: reindex ", name),
        rule("density_warning", lower, "warning", density, "leaf density ", fixed_text(density, 1), "%: watch ", name),
        rule("free_critical", roomier, "critical", free, "free pages ", fixed_text(free, 1), "%: reindex ", name),
        rule("free_warning", roomy, "warning", free, "free pages ", fixed_text(free, 1), "%: watch ", name),
        rule("fragmentation", split, "warning", frag, "leaf fragmentation ", fixed_text(frag, 1), "%"),
        rule("deleted_pages", cleared, "info", deleted, deleted, " deleted pages"),
        rule("healthy", none & (density >= 70) & (free <= 20), "ok", density, name, " is healthy"),
        rule("pending_high", gin & (pending > 1000), "warning", pending, pending, " pending tuples: run VACUUM"),
        rule("pending", gin & (pending > 100) & (pending <= 1000), "info", pending, pending, " pending tuples"),
        rule("dead_items", hashed & (dead > 100), "warning", dead, dead, " dead items: run VACUUM"),
    ]
    return findings(stats, "index_bloat", rules, keys)


def index_bloat_rollup(indexes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    order = [F.desc("estimated_bloat_percent"), F.desc("index_size"), F.asc("index_name")]
    groups = [
        ("critical_indexes", "critical", F.col("bloat_severity") == "critical", " indexes with critical bloat"),
        ("high_indexes", "high", F.col("bloat_severity") == "high", " indexes with high bloat"),
        ("density_under_70", "warning", F.col("avg_leaf_density") < 70, " indexes below 70% leaf density"),
    ]
    return _rollup(indexes, "index_bloat", "index_name", groups, order, keys)


def index_bloat(
    samples: DataFrame,
    index: str | None = None,
    table: str | None = None,
    schema: str = "public",
    min_index_size_gb: float = 5,
    min_bloat_percent: float = 20,
    keys: Sequence[str] = KEYS,
    limit: int | None = 50,
) -> dict[str, DataFrame]:
    """Bloat of one index, of one table's indexes, or of the B-trees of a schema.

    In the last form the bloated ones among the ``limit`` largest are listed (``None``: all); summary and findings cover all.
    """
    keys = list(keys)
    d = samples.filter(F.col("schemaname") == schema)
    if index:
        stats = index_stats(d.filter(F.col("index_name") == index), keys)
        return {"indexes": stats, "findings": index_bloat_findings(stats, keys)}
    d = d.filter(F.col("size_bytes") >= gb_to_bytes(min_index_size_gb))
    bloated = F.col("estimated_bloat_percent") >= min_bloat_percent
    if table:
        stats = index_stats(d.filter(F.col("relname") == table), keys)
        # Other access methods have no bloat estimate and are always shown.
        shown = F.coalesce(bloated, F.lit(False)) | (F.col("index_type") != "btree")
        rows = stats.filter(shown)
        summary = stats.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("indexes_analyzed"), F.count_if(shown).alias("indexes_with_bloat")
        )
        return {"indexes": rows, "summary": summary, "findings": index_bloat_findings(rows, keys)}
    btrees = d.filter((F.col("access_method") == "btree") & not_system_schema("schemaname"))
    wasted = (F.col("index_size") * F.col("estimated_bloat_percent") / F.lit(100.0)).cast("long")
    stats = btree_stats(btrees, keys).withColumn("bloated_bytes", wasted)
    largest = topn(stats, limit, [F.desc("index_size"), F.asc("index_name")], keys)

    def listed(df: DataFrame) -> DataFrame:
        return df.filter(bloated).select(*columns)

    columns = (
        *keys,
        "index_name",
        "table_name",
        "index_size",
        format_bytes("index_size").alias("index_size_pretty"),
        "avg_leaf_density",
        "leaf_fragmentation",
        "estimated_bloat_percent",
        "bloat_severity",
        format_bytes("bloated_bytes").alias("estimated_wasted_space"),
    )
    rows = listed(largest)
    zero = F.lit(0).cast("long")
    summary = stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("indexes_analyzed"),
        F.count_if(bloated).alias("indexes_with_bloat"),
        format_bytes(F.sum("index_size")).alias("total_index_size"),
        format_bytes(F.coalesce(F.sum(F.when(bloated, F.col("bloated_bytes"))), zero)).alias("estimated_bloated_space"),
    )
    return {"indexes": rows, "summary": summary, "findings": index_bloat_rollup(listed(stats), keys)}
