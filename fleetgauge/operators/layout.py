"""Index advice from a statement workload: columns used, candidates, measured improvement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.expressions import (
    exclude_like,
    fixed_text,
    is_select,
    round_half_up_div,
)
from fleetgauge.functions.frames import topn

# Statements left out of a workload.
WORKLOAD_EXCLUDED = ("%pg_catalog%", "%information_schema%", "%pg_toast%", "%pg_%", "%$%")


def workload_statements(
    statements: DataFrame,
    min_calls: int = 5,
    min_avg_time_ms: float = 5,
    limit: int | None = 50,
    keys: Sequence[str] = KEYS,
    own: DataFrame | None = None,
) -> DataFrame:
    """The SELECT statements that took most time in total; ``limit`` of a key, ``None`` for all.

    ``own`` (``queryid``, and any of ``keys``) names the caller's statements instead: all of them count, whatever their time.
    """
    if own is not None:
        named = [c for c in (*keys, "queryid") if c in own.columns]
        return statements.join(own.select(*named).distinct(), named, "left_semi").select(*keys, "queryid").distinct()
    kept = statements.filter(
        (F.col("calls") >= min_calls)
        & (F.col("total_exec_us") >= F.col("calls") * F.lit(int(round(min_avg_time_ms * 1000))))
        & exclude_like("query", WORKLOAD_EXCLUDED)
        & is_select("query")
    )
    return topn(kept, limit, [F.desc_nulls_first("total_exec_us"), F.asc("queryid")], keys).select(*keys, "queryid")


def resolve_columns(
    column_usage: DataFrame, query_tables: DataFrame, id_cols: Sequence[str] = ("cluster_id", "queryid")
) -> DataFrame:
    """Give unqualified columns their table where the statement reads exactly one."""
    single = (
        query_tables.groupBy(*id_cols)
        .agg(F.min("table_name").alias("_first"), F.max("table_name").alias("_last"))
        .filter(F.col("_first") == F.col("_last"))
        .select(*id_cols, "_first")
    )
    return (
        column_usage.join(single, list(id_cols), "left")
        .withColumn("table_name", F.coalesce("table_name", "_first"))
        .filter(F.col("table_name").isNotNull())
        .select(*id_cols, "table_name", "column_name")
        .distinct()
    )


def workload_columns(
    workload: DataFrame,
    column_usage: DataFrame,
    keys: Sequence[str] = KEYS,
    id_cols: Sequence[str] = ("cluster_id", "queryid"),
) -> DataFrame:
    """Columns the workload uses per table, with the number of statements using each."""
    return (
        workload.join(column_usage, list(id_cols))
        .groupBy(*keys, "table_name", "column_name")
        .agg(F.count_distinct("queryid").alias("statements"))
    )


def layout_candidates(columns: DataFrame, keys: Sequence[str] = KEYS, width: int = 3) -> DataFrame:
    """One candidate per column, and one over the ``width`` most used columns of a table."""
    keys = list(keys)
    single = columns.select(
        *keys, "table_name", F.col("column_name").alias("columns"), F.lit("single column in use").alias("reason")
    )
    order = [F.desc("statements"), F.asc("column_name")]
    rank = F.row_number().over(Window.partitionBy(*keys, "table_name").orderBy(*order))
    lead = columns.withColumn("_r", rank).filter(F.col("_r") <= width)
    pairs = F.array_sort(F.collect_list(F.struct("_r", "column_name")))
    several = (
        lead.groupBy(*keys, "table_name")
        .agg(pairs.alias("_p"))
        .filter(F.size("_p") > 1)
        .select(
            *keys,
            "table_name",
            F.array_join(F.transform("_p", lambda p: p["column_name"]), ",").alias("columns"),
            F.lit("several columns in use").alias("reason"),
        )
    )
    return single.unionByName(several)


def score_candidates(
    candidates: DataFrame,
    what_if: DataFrame,
    workload: DataFrame,
    keys: Sequence[str] = KEYS,
    id_cols: Sequence[str] = ("cluster_id", "queryid"),
) -> DataFrame:
    """Mean improvement of each candidate over the workload statements it changes.

    Improvements are kept at six decimals, so their sum does not depend on the order of rows, and their mean is rounded exactly.
    """
    keys = list(keys)
    old, new = F.col("cost_before"), F.col("cost_after")
    gain = F.round((old - new) / old * 100, 6).cast("decimal(20,6)")
    measured = (
        # A semi-join first: it can go below an aggregate that makes the costs.
        what_if.join(workload.select(*id_cols).distinct(), list(id_cols), "left_semi")
        .filter(F.col("would_use") & (old != 0) & (new > 0))
        .withColumn("gain", gain)
        .filter(F.col("gain") != 0)
        .withColumnRenamed("candidate_columns", "columns")
        .join(workload, list(id_cols))
        .groupBy(*keys, "table_name", "columns")
        .agg((F.sum("gain") * 1_000_000).cast("long").alias("_sum"), F.count(F.lit(1)).alias("_improved"))
    )
    totals = workload.groupBy(*keys).agg(F.count(F.lit(1)).alias("_queries"))
    found = candidates.select(*keys, "table_name", "columns").join(measured, [*keys, "table_name", "columns"])
    return found.join(totals, keys).select(
        *keys,
        "table_name",
        "columns",
        (F.signum("_sum") * round_half_up_div(F.abs("_sum"), F.col("_improved") * 100, 1) / 10_000).alias("estimated_improvement_percent"),
        F.concat(
            F.lit("serves "), F.col("_improved").cast("string"), F.lit(" of "), F.col("_queries").cast("string"), F.lit(" statements")
        ).alias("reason"),
    )


#: A page's bytes less header and special space, the share of a leaf that is filled, and the bytes of an entry beside
#: its columns (line pointer and tuple header), which are aligned to eight.
PAGE_BYTES, PAGE_ROOM, FILL_PERCENT, ENTRY_BYTES, ALIGNED = 8192, 8152, 90, 12, 8


def estimated_sizes(
    candidates: DataFrame, widths: DataFrame, table_rows: DataFrame, id_cols: Sequence[str] = ("cluster_id",)
) -> DataFrame:
    """The bytes a B-tree over each distinct candidate would take: ``id_cols``, ``table_name``, ``columns``, ``estimated_size_bytes``.

    ``widths`` has the mean bytes of each column (``table_name``, ``column_name``, ``avg_width``), ``table_rows`` the rows of each
    table (``table_name``, ``row_count``). Leaves are filled to 90 %, one level of inner pages stands above several leaves, and a page
    is the index's own. Unknown where a width or the number of rows is.
    """
    table = [*id_cols, "table_name"]
    each = candidates.select(*table, "columns").distinct()
    parts = each.withColumn("column_name", F.explode(F.split("columns", ",")))
    known = parts.join(widths.select(*table, "column_name", "avg_width"), [*table, "column_name"], "left")
    width = F.when(F.count("avg_width") == F.count(F.lit(1)), F.sum("avg_width"))
    whole = known.groupBy(*table, "columns").agg(width.cast("long").alias("_width")).join(table_rows.select(*table, "row_count"), table, "left")
    entry = F.expr(f"{ENTRY_BYTES} + {ALIGNED} * ((_width + {ALIGNED - 1}) div {ALIGNED})")
    sized = whole.withColumn("_entry", entry).withColumn("_held", F.expr(f"if(_entry is null, null, greatest({PAGE_ROOM} * {FILL_PERCENT} div 100 div _entry, 1))"))
    leaves = sized.withColumn("_leaves", F.expr("if(row_count is null or _held is null, null, greatest((row_count + _held - 1) div _held, 1))"))
    pages = F.expr("1 + _leaves + if(_leaves > 1, (_leaves + _held - 1) div _held, 0)")
    return leaves.select(*table, "columns", (pages * PAGE_BYTES).alias("estimated_size_bytes"))


def _with_sizes(df: DataFrame, sizes: DataFrame | None, id_cols: Sequence[str]) -> DataFrame:
    if sizes is None:
        return df.withColumn("estimated_size_bytes", F.lit(None).cast("long"))
    return df.join(sizes, [*id_cols, "table_name", "columns"], "left")


def recommend_layout(
    scored: DataFrame,
    max_recommendations: int | None = 10,
    min_improvement_percent: float = 10,
    tables: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    sizes: DataFrame | None = None,
    id_cols: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    """The best candidates of the wanted tables above the threshold; both filters come before the cut.

    ``sizes``: the :func:`estimated_sizes` per ``id_cols``; without them the size is NULL.
    """
    if tables:
        scored = scored.filter(F.lower("table_name").isin(*[t.lower() for t in tables]))
    order = [F.desc_nulls_last("estimated_improvement_percent"), F.asc("table_name"), F.asc("columns")]
    best = topn(scored.filter(F.col("estimated_improvement_percent") >= min_improvement_percent), max_recommendations, order, keys)
    statement = F.concat(
        F.lit("CREATE INDEX ON "), "table_name", F.lit(" USING btree ("), F.replace("columns", F.lit(","), F.lit(", ")), F.lit(")")
    )
    return _with_sizes(best, sizes, id_cols).select(
        *keys,
        "table_name",
        "columns",
        F.lit("btree").alias("using"),
        "estimated_size_bytes",
        "estimated_improvement_percent",
        "reason",
        statement.alias("create_statement"),
    )


def recommend_for_statement(
    candidates: DataFrame,
    what_if: DataFrame,
    max_recommendations: int | None = 5,
    id_cols: Sequence[str] = ("cluster_id", "queryid"),
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Candidates one statement would use, by its own improvement, with their sizes; unmeasured gains come last."""
    old, new = F.col("cost_before"), F.col("cost_after")
    gain = F.when((old != 0) & (new > 0), F.round((old - new) / old * 100, 4))
    tried = (
        what_if.filter("would_use")
        .withColumnRenamed("candidate_columns", "columns")
        .join(candidates.select("cluster_id", "table_name", "columns").distinct(), ["cluster_id", "table_name", "columns"], "left_semi")
        .withColumn("estimated_improvement_percent", gain)
    )
    order = [
        F.desc(F.coalesce("estimated_improvement_percent", F.lit(0.0))),
        F.asc("table_name"),
        F.asc("columns"),
    ]
    reason = F.when(
        F.coalesce("estimated_improvement_percent", F.lit(0.0)) != 0,
        F.concat(
            F.lit("cost less by "), fixed_text(F.col("estimated_improvement_percent"), 1), F.lit("%")
        ),
    ).otherwise("appears in the new plan")
    best = _with_sizes(topn(tried, max_recommendations, order, id_cols), sizes, ["cluster_id"])
    return best.select(*id_cols, "table_name", "columns", "estimated_size_bytes", "estimated_improvement_percent", reason.alias("reason"))


def recommend_indexes(
    statements: DataFrame,
    column_usage: DataFrame,
    what_if: DataFrame,
    query_tables: DataFrame | None = None,
    max_recommendations: int | None = 10,
    min_improvement_percent: float = 10,
    tables: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    widths: DataFrame | None = None,
    table_rows: DataFrame | None = None,
    min_calls: int = 5,
    min_avg_time_ms: float = 5,
    workload_limit: int | None = 50,
    own_statements: DataFrame | None = None,
    store: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows,
    id_cols: Sequence[str] = ("cluster_id", "queryid"),
) -> dict[str, DataFrame | None]:
    """The whole pipeline from statements to recommended indexes.

    The workload is the heaviest statements (``min_calls``, ``min_avg_time_ms``, ``workload_limit``), or ``own_statements``. Sizes are
    estimated from ``widths`` and ``table_rows``. ``store`` is given the workload and the candidates, which several steps read, and
    returns their rows from where it keeps them; without it each reader computes them. Columns are resolved for the workload alone.
    """
    keys, ids = list(keys), list(id_cols)
    workload = store("workload", workload_statements(statements, min_calls, min_avg_time_ms, workload_limit, keys, own_statements))
    named = workload.select(*ids).distinct()
    usage = column_usage.join(named, ids, "left_semi")
    if query_tables is not None:
        usage = resolve_columns(usage, query_tables.join(named, ids, "left_semi"), ids)
    candidates = store("candidates", layout_candidates(workload_columns(workload, usage, keys, ids), keys))
    scored = score_candidates(candidates, what_if, workload, keys)
    sizes = None if widths is None or table_rows is None else estimated_sizes(candidates, widths, table_rows)
    best = recommend_layout(scored, max_recommendations, min_improvement_percent, tables, keys, sizes)
    analyzed = workload.groupBy(*keys).agg(F.count(F.lit(1)).alias("analyzed_queries"))
    found = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    summary = analyzed.join(found, keys, "left").select(
        *keys, "analyzed_queries", F.coalesce("_n", F.lit(0).cast("long")).alias("total_recommendations")
    )
    return {"recommendations": best, "candidates": candidates, "summary": summary, "sizes": sizes}
