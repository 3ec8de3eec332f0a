"""Logged query plans: flattening of plan JSON, plan rules, before/after comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.expressions import (
    fixed_text,
    round_exact,
)
from fleetgauge.functions.frames import Rule, findings, text

# Limits of the plan rules.
SEQ_SCAN_ROWS = 10_000
ROW_ESTIMATE_RATIO = 10
HASH_BATCHES = 1
NESTED_LOOP_LOOPS = 1_000

PLAN_KEYS = ("plan_id",)

# Plan JSON field, output column, type.
NODE_FIELDS = (
    ("Node Type", "node_type", "string"),
    ("Relation Name", "relation_name", "string"),
    ("Index Name", "index_name", "string"),
    ("Plan Rows", "plan_rows", "double"),
    ("Actual Rows", "actual_rows", "double"),
    ("Actual Loops", "actual_loops", "double"),
    ("Hash Batches", "hash_batches", "double"),
    ("Sort Method", "sort_method", "string"),
    ("Filter", "filter_cond", "string"),
    ("Startup Cost", "startup_cost", "double"),
    ("Total Cost", "total_cost", "double"),
)

# Breadth-first walk of one plan inside one row: `front` holds the nodes of the current level,
# `levels_done` the levels already passed, which are strung together once, at the end. The text
# cannot be deeper than it has "Plans" fields, so the walk needs no depth limit, no join per level
# and no shuffle.
_NODE = "struct<node_id: string, parent_id: string, depth: int, node: variant>"
_WALK = f"""
reduce(
  sequence(1, levels),
  named_struct(
    'front', if(root is null, cast(array() as array<{_NODE}>),
                array(named_struct('node_id', '1', 'parent_id', cast(null as string), 'depth', 1, 'node', root))),
    'levels_done', cast(array() as array<array<{_NODE}>>)),
  (acc, i) -> if(size(acc.front) = 0, acc, named_struct(
    'front', flatten(transform(acc.front, n -> transform(
      coalesce(try_variant_get(n.node, '$.Plans', 'array<variant>'), cast(array() as array<variant>)),
      (child, j) -> named_struct(
        'node_id', concat(n.node_id, '.', cast(j + 1 as string)), 'parent_id', n.node_id, 'depth', i + 1, 'node', child)))),
    'levels_done', array_append(acc.levels_done, acc.front))),
  acc -> flatten(acc.levels_done))
"""
# All fields of a node in one pass over its document; a missing field is NULL.
_FIELDS = "struct<" + ", ".join(f"`{name}`: {kind}" for name, _, kind in NODE_FIELDS) + ">"


def _unwrapped(plans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The plan document (first element of a list, or the object itself) of every row."""
    fields = (F.length("plan") - F.length(F.replace(F.col("plan"), F.lit('"Plans"'), F.lit("")))) / len('"Plans"')
    return plans.select(
        *keys, F.try_parse_json("plan").alias("_doc"), (F.coalesce(fields.cast("int"), F.lit(0)) + 1).alias("levels")
    ).withColumn("_doc", F.coalesce(F.expr("try_variant_get(_doc, '$[0]', 'variant')"), F.col("_doc")))


def normalize_plans(plans: DataFrame, keys: Sequence[str] = PLAN_KEYS) -> dict[str, DataFrame]:
    """Plan JSON text (list or object) to node rows and one row of facts per plan.

    ``node_id`` is the path from the root (``1.2.1``); text that is no JSON yields a fact row with
    ``parsed`` false and no nodes.
    """
    docs = _unwrapped(plans, keys)
    rooted = docs.withColumn("root", F.coalesce(F.expr("try_variant_get(_doc, '$.Plan', 'variant')"), F.col("_doc")))
    walked = rooted.select(*keys, F.expr(f"inline({_WALK})"))
    own = ["node_id", "parent_id", "depth"]
    typed = walked.select(*keys, *own, F.expr(f"try_variant_get(node, '$', '{_FIELDS}')").alias("f"))
    nodes = typed.select(*keys, *own, *[F.col("f").getField(name).alias(column) for name, column, _ in NODE_FIELDS])
    facts = docs.select(
        *keys,
        F.col("_doc").isNotNull().alias("parsed"),
        F.expr("try_variant_get(_doc, '$[\"Execution Time\"]', 'double')").alias("execution_time_ms"),
        F.expr("try_variant_get(_doc, '$[\"Planning Time\"]', 'double')").alias("planning_time_ms"),
    )
    return {"nodes": nodes, "plans": facts}


def lint_plans(nodes: DataFrame, keys: Sequence[str] = PLAN_KEYS) -> DataFrame:
    """Warnings per plan node."""
    kind, actual, planned = F.col("node_type"), F.col("actual_rows"), F.col("plan_rows")
    rows = F.coalesce(actual, planned, F.lit(0))
    big_scan = (kind == "Seq Scan") & (rows > SEQ_SCAN_ROWS)
    ratio = F.when(planned > 0, actual / planned)
    off = F.coalesce((ratio > ROW_ESTIMATE_RATIO) | (ratio < 1 / ROW_ESTIMATE_RATIO), F.lit(False))
    batches = F.coalesce("hash_batches", F.lit(1))
    loops = F.coalesce("actual_loops", F.lit(1))
    external = F.coalesce(F.lower("sort_method").contains("external"), F.lit(False))
    where = F.coalesce("relation_name", F.lit("unknown"))
    has_filter = F.coalesce(F.length("filter_cond") > 0, F.lit(False))
    subject = F.col("node_id")

    def whole(c):
        return c.cast("long")

    rules = [
        Rule("seq_scan", big_scan, "warning", subject, rows, text("sequential scan of ", where, " read ", whole(rows), " rows")),
        Rule(
            "seq_scan_filter",
            big_scan & has_filter,
            "advice",
            subject,
            rows,
            text("consider an index for ", F.coalesce("filter_cond", F.lit(""))),
        ),
        Rule(
            "row_estimate",
            off,
            "warning",
            subject,
            ratio,
            text(kind, ": planned ", whole(planned), ", actual ", whole(actual), " rows, ratio ", fixed_text(ratio, 2)),
        ),
        Rule(
            "hash_spill",
            kind.contains("Hash") & (batches > HASH_BATCHES),
            "warning",
            subject,
            batches,
            text(kind, " spilled to disk in ", whole(batches), " batches"),
        ),
        Rule(
            "sort_spill",
            (kind == "Sort") & external,
            "warning",
            subject,
            F.lit(None).cast("double"),
            text("sort spilled to disk: ", F.coalesce("sort_method", F.lit(""))),
        ),
        Rule(
            "nested_loop",
            (kind == "Nested Loop") & (loops > NESTED_LOOP_LOOPS),
            "warning",
            subject,
            loops,
            text("nested loop ran ", whole(loops), " times"),
        ),
    ]
    return findings(nodes, "plan", rules, keys)


def _root_costs(nodes: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    cost = F.coalesce("total_cost", F.lit(0.0)).cast("double").alias(name)
    return nodes.filter(F.col("parent_id").isNull()).select(*keys, cost)


def compare_plans(before: DataFrame, after: DataFrame, keys: Sequence[str] = PLAN_KEYS) -> DataFrame:
    """Root cost before and after a change, with the improvement in percent."""
    d = _root_costs(before, "original_cost", keys).join(_root_costs(after, "cost_with_indexes", keys), list(keys))
    old, new = F.col("original_cost"), F.col("cost_with_indexes")
    return d.withColumn("estimated_improvement_percent", F.when(old > 0, round_exact((old - new) / old * 100, 2)))


def used_indexes(after: DataFrame, created: DataFrame, keys: Sequence[str] = PLAN_KEYS) -> DataFrame:
    """Index nodes of the new plan that use one of the created indexes (``created``: keys, index name)."""
    nodes = after.filter(F.col("node_type").contains("Index") & F.col("index_name").isNotNull())
    names = created.select(*keys, F.col("index_name").alias("_created"))
    on = F.lit(True)
    for k in keys:
        on = on & (nodes[k] == names[k])
    return nodes.join(names, on & nodes["index_name"].contains(names["_created"]), "left_semi").select(
        *keys, "node_id", "index_name", F.col("node_type").alias("scan_type"), "startup_cost", "total_cost"
    )
