"""Plan JSON, plan rules, baselines, sources, streaming, and the shape of physical plans."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from fleetgauge.operators import baseline as X
from fleetgauge.operators import sessions as S
from fleetgauge.plans import explain as E
from fleetgauge.queries import registry
from fleetgauge.session import shared_dir
from fleetgauge.sources.derive import Telemetry
from fleetgauge.sources.schemas import SCHEMAS
from fleetgauge.sources.telemetry import read_baseline, read_telemetry, write_baseline, write_report, write_telemetry
from fleetgauge.streaming import live

SF = "/root/testdata/sf0.001"


def _plans(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "plan_id long, plan string")


def _walk(node, node_id="1", parent=None, depth=1):
    yield node_id, parent, depth, node.get("Node Type")
    for i, child in enumerate(node.get("Plans", []), 1):
        yield from _walk(child, f"{node_id}.{i}", node_id, depth + 1)


def test_plan_shapes_and_depth(spark):
    deep = {"Node Type": "n60"}
    for i in range(59, 0, -1):
        deep = {"Node Type": f"n{i}", "Plans": [deep, {"Node Type": "leaf"}]}
    bushy = {"Node Type": "Append", "Plans": [{"Node Type": f"c{i}", "Plans": [{"Node Type": "x"}]} for i in range(30)]}
    docs = [[{"Plan": bushy, "Execution Time": 2.5, "Planning Time": 1}], {"Plan": deep}, bushy, "no json", None, {"Plan": {"Node Type": "Result", "Plan Rows": "many"}}]
    out = E.normalize_plans(_plans(spark, *docs))
    got = {}
    for r in out["nodes"].collect():
        got.setdefault(r.plan_id, set()).add((r.node_id, r.parent_id, r.depth, r.node_type))
    assert got[0] == got[2] == set(_walk(bushy))
    assert got[1] == set(_walk(deep))
    assert 3 not in got and 4 not in got
    facts = {r.plan_id: (r.parsed, r.execution_time_ms, r.planning_time_ms) for r in out["plans"].collect()}
    assert facts[0] == (True, 2.5, 1.0) and facts[3] == facts[4] == (False, None, None)
    # A field of another type is unknown, not an error.
    assert out["nodes"].filter("plan_id = 5").first().plan_rows is None


@pytest.mark.parametrize(
    ("node", "rules"),
    [
        ({"Node Type": "Seq Scan", "Actual Rows": 10000}, []),
        ({"Node Type": "Seq Scan", "Actual Rows": 10001}, ["seq_scan"]),
        ({"Node Type": "Seq Scan", "Plan Rows": 50000, "Filter": "(a = 1)"}, ["seq_scan", "seq_scan_filter"]),
        ({"Node Type": "Seq Scan", "Actual Rows": 5, "Plan Rows": 50000}, ["row_estimate"]),
        ({"Node Type": "Sort", "Actual Rows": 100, "Plan Rows": 10}, []),
        ({"Node Type": "Sort", "Actual Rows": 101, "Plan Rows": 10}, ["row_estimate"]),
        ({"Node Type": "Sort", "Actual Rows": 1, "Plan Rows": 10}, []),
        ({"Node Type": "Sort", "Actual Rows": 0, "Plan Rows": 10}, ["row_estimate"]),
        ({"Node Type": "Sort", "Actual Rows": 5, "Plan Rows": 0}, []),
        ({"Node Type": "Hash Join", "Hash Batches": 1}, []),
        ({"Node Type": "Hash", "Hash Batches": 2}, ["hash_spill"]),
        ({"Node Type": "Sort", "Sort Method": "External Merge"}, ["sort_spill"]),
        ({"Node Type": "Sort", "Sort Method": "quicksort"}, []),
        ({"Node Type": "Nested Loop", "Actual Loops": 1000}, []),
        ({"Node Type": "Nested Loop", "Actual Loops": 1001}, ["nested_loop"]),
    ],
)
def test_plan_rules(spark, node, rules):
    nodes = E.normalize_plans(_plans(spark, [{"Plan": {"Node Type": "Result", "Plans": [node]}}]))["nodes"]
    assert sorted(r.rule for r in E.lint_plans(nodes).collect()) == rules


def test_compare_plans(spark):
    before = E.normalize_plans(_plans(spark, {"Plan": {"Node Type": "Seq Scan", "Total Cost": 200}}, {"Plan": {"Node Type": "Result"}}))["nodes"]
    new = {"Plan": {"Node Type": "Index Scan", "Index Name": "<7>btree_t_a", "Total Cost": 50.5, "Plans": [{"Node Type": "Index Scan", "Index Name": "other"}]}}
    after = E.normalize_plans(_plans(spark, new, {"Plan": {"Node Type": "Result"}}))["nodes"]
    got = {r.plan_id: (r.original_cost, r.cost_with_indexes, r.estimated_improvement_percent) for r in E.compare_plans(before, after).collect()}
    assert got == {0: (200.0, 50.5, 74.75), 1: (0.0, 0.0, None)}
    created = spark.createDataFrame([(0, "btree_t_a"), (0, "btree_t"), (1, "other")], "plan_id long, index_name string")
    assert [(r.node_id, r.index_name) for r in E.used_indexes(after, created).collect()] == [("1", "<7>btree_t_a")]


def test_baseline_diff(spark):
    before = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, None), ("c", 3.0, 3.0)], "id string, x double, y double")
    after = spark.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, None), ("d", 0.0, 0.0)], "id string, x double, y double")
    got = {r.id: (r.change, r.y_delta) for r in X.baseline_diff(before, after, ["id"], ["x", "y"]).collect()}
    assert got == {"a": ("changed", 3.0), "b": ("same", None), "c": ("removed", None), "d": ("added", None)}


def _new_dir(spark):
    folder = shared_dir(spark)
    os.makedirs(folder, exist_ok=True)
    return tempfile.mkdtemp(dir=folder)


def test_telemetry_round_trip_prunes_partitions(spark):
    root = _new_dir(spark)
    schema = SCHEMAS["wal"]
    rows = [(f"c{c}", dt.datetime(2024, 1, d, 5), c, d, 0, 0) for c in range(3) for d in range(1, 6)]
    write_telemetry(spark.createDataFrame(rows, schema), root, "wal")
    back = read_telemetry(spark, root, "wal", clusters=["c1"], since=dt.date(2024, 1, 2), until=dt.date(2024, 1, 4))
    assert back.columns == [f.name for f in schema.fields]
    assert sorted(r.wal_fpi for r in back.collect()) == [2, 3]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "snapshot_date" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "cluster_id" in plan.split("PushedFilters")[1]


def test_reports(spark):
    root = _new_dir(spark)
    df = spark.createDataFrame([("a", 1, None)], "k string, v int, w int")
    write_report(df, f"{root}/j")
    assert json.loads(spark.read.text(f"{root}/j").first()[0]) == {"k": "a", "v": 1, "w": None}
    write_report(df, f"{root}/p", "parquet")
    assert spark.read.parquet(f"{root}/p").count() == 1
    with pytest.raises(ValueError):
        write_report(df, f"{root}/x", "xml")


def _files(root):
    return sorted(f for d, _, names in os.walk(root) for f in names if f.endswith(".parquet") for f in [os.path.join(d, f)])


def test_a_repeated_run_replaces_its_own_days(spark):
    """Also when it comes with fewer days; other runs, and days it does not hold, stay."""
    root, schema = _new_dir(spark), SCHEMAS["wal"]

    def write(run, days, add=0):
        rows = [(f"c{c}", dt.datetime(2024, 1, d, 5), c + add, d, 0, 0) for c in range(3) for d in days]
        write_telemetry(spark.createDataFrame(rows, schema), root, "wal", run=run)

    def seen():
        return sorted(tuple(r)[:4] for r in read_telemetry(spark, root, "wal").collect())

    write("one", range(1, 5))
    once, files = seen(), len(_files(root))
    write("one", range(1, 5))
    assert seen() == once and len(_files(root)) == files
    write("two", [2])
    assert len(seen()) == len(once) + 3
    write("one", [3], add=10)
    assert len(seen()) == len(once) + 3 and {r[2] for r in seen() if r[3] == 3} == {10, 11, 12}


def test_baseline_files_are_clustered_and_repeatable(spark):
    root = _new_dir(spark)
    rows = [("c", dt.datetime(2024, 1, d), f"s{s}", f"i{i}", "m", float(i)) for d in (1, 2) for s in range(3) for i in range(200)]
    metrics = spark.createDataFrame(rows, "cluster_id string, snapshot_ts timestamp, section string, item string, metric string, value double").repartition(8)
    for _ in range(2):
        write_baseline(metrics, f"{root}/b")
        back = read_baseline(spark, f"{root}/b", metrics.schema, sections=["s1"], since=dt.date(2024, 1, 2))
        assert back.columns == metrics.columns and sorted(map(tuple, back.collect())) == sorted(r for r in rows if r[2] == "s1" and r[1].day == 2)
        assert len(_files(f"{root}/b")) == 6
    plan = back._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "section" in plan and "snapshot_date" in plan


def test_schemas_carry_the_keys():
    for name, schema in SCHEMAS.items():
        assert [f.name for f in schema.fields][:2] == ["cluster_id", "snapshot_ts"], name


def test_per_batch_top_n(spark):
    t = Telemetry(spark, SF)
    root, out, mark = _new_dir(spark), _new_dir(spark), _new_dir(spark)
    t["t_activity"].write.parquet(f"{root}/a")
    stream = spark.readStream.schema(t["t_activity"].schema).parquet(f"{root}/a")
    query = live.per_batch(stream, S.sessions_by_state, out, mark, once=True)
    query.awaitTermination(120)
    assert spark.read.parquet(out).agg(F.sum("count")).first()[0] == t["t_activity"].filter("backend_type = 'client backend'").count()


#: The library's own queries: the optional subpackage has tests of its own.
OWN = registry.QUERIES
NO_STREAM = sorted(n for n in OWN if not n.endswith("_stream"))


@pytest.mark.parametrize("name", NO_STREAM)
def test_no_nested_loops_nor_single_partitions(spark, name):
    """With automatic broadcasts off, every join has to be a sort-merge or hash join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = OWN[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for word in ("NestedLoop", "Cartesian", "BroadcastExchange", "SinglePartition", "Python", "InPandas"):
        assert word not in plan


def test_columns_are_pruned_at_the_scan(spark):
    plan = driver.queries()["p3_table_hotspots"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lineitem = next(line for line in plan.splitlines() if "ReadSchema" in line and "l_suppkey" in line)
    assert "l_extendedprice" not in lineitem.split("ReadSchema")[1]


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(OWN)


def test_report_order(spark):
    from fleetgauge.operators.ordering import in_report_order

    rows = [("idle", 5, 1), ("active", 3, 2), ("active", None, 3), ("active", 9, 4)]
    df = spark.createDataFrame(rows, "state string, duration_seconds long, pid long")
    assert [r.pid for r in in_report_order(df, "active_queries", []).collect()] == [3, 4, 2, 1]


def test_baseline_reads_each_table_once_per_purpose(spark):
    """Under the scans and shuffles of the separate reports, and the same metrics."""
    from fleetgauge.queries.plans_layout import _telemetry

    t, root = _telemetry(Telemetry(spark, SF)), _new_dir(spark)
    for name, df in t.items():
        df.write.parquet(f"{root}/{name}")
    stored = {name: spark.read.parquet(f"{root}/{name}") for name in t}
    fused, apart = X.baseline_pass(stored), X.baseline_metrics(X.baseline_report(stored))
    assert sorted(map(tuple, fused.collect()), key=repr) == sorted(map(tuple, apart.collect()), key=repr)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (fused, apart)]
    scans, moves = [p.count("FileScan") for p in plans], [p.count("Exchange hashpartitioning") for p in plans]
    assert scans[0] <= 18 and scans[0] < 0.6 * scans[1] and moves[0] < 0.4 * moves[1]
    without = {k: v for k, v in stored.items() if k != "index_defs"}
    assert X.baseline_pass(without).filter("metric = 'score' and section = 'index_health'").count() > 0


def test_baseline_plan_before_it_runs(spark):
    """A plan that ran prints its first form as well, so scans and shuffles are counted before."""
    from fleetgauge.queries.plans_layout import _telemetry

    t, root = _telemetry(Telemetry(spark, SF)), _new_dir(spark)
    for name, df in t.items():
        df.limit(0).write.parquet(f"{root}/{name}")
    stored = {name: spark.read.parquet(f"{root}/{name}") for name in t}
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (X.baseline_pass(stored), X.baseline_metrics(X.baseline_report(stored)))]
    scans, moves = [p.count("FileScan") for p in plans], [p.count("Exchange hashpartitioning") for p in plans]
    assert scans[0] <= 16 and scans[0] < 0.6 * scans[1] and moves[0] <= 10 and moves[0] < 0.4 * moves[1]


@pytest.mark.parametrize("name", ["x1_baseline_metrics", "x1_baseline_report", "h7_index_findings"])
def test_reports_do_not_aggregate_the_lines_for_each_reader(spark, name):
    """Tables and indexes are stored once; the lines are read again at most for index definitions and for one joined side."""
    plan = driver.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "lineitem.parquet" in line for line in plan.splitlines()) <= 4


@pytest.mark.parametrize("name", ["p23_recommend_layout", "p23_recommend_summary", "p23_recommend_for_statement", "p23_recommend_for_own_statements"])
def test_advice_makes_its_workload_and_candidates_once(spark, name):
    """The statements (out of orders alone) are not aggregated again by the steps that read them."""
    plan = driver.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "o_totalprice" in line for line in plan.splitlines()) == 0


def test_keys_with_all_nine_checks(spark):
    """On one time grid the facts of all tables meet, and the score is the mean of nine."""
    rows = driver.queries()["h6_whole_checks"](spark, SF).groupBy("cluster_id", "snapshot_ts").agg(F.count("check_name").alias("n"), F.count_distinct("check_name").alias("kinds"), F.sum("score").alias("total")).collect()
    assert max(r.n for r in rows) == 9 and all(r.n == r.kinds for r in rows) and sum(r.n == 9 for r in rows) >= 10
    overall = {(r.cluster_id, r.snapshot_ts): r for r in driver.queries()["h6_whole_overall"](spark, SF).collect()}
    for r in rows:
        assert overall[r.cluster_id, r.snapshot_ts].checks == r.n and abs(overall[r.cluster_id, r.snapshot_ts].overall_score - r.total / r.n) <= 0.05 + 1e-9


def test_fifty_levels_touch_every_node_once(spark):
    def plan(depth):
        node = {"Node Type": "Seq Scan", "Total Cost": 1}
        for level in range(depth - 1):
            node = {"Node Type": "Append", "Total Cost": level, "Plans": [node, {"Node Type": "Result", "Plan Rows": level}]}
        return {"Plan": node}

    nodes = E.normalize_plans(_plans(spark, plan(50)))["nodes"].collect()
    assert len(nodes) == 99 and max(r.depth for r in nodes) == 50 and len({r.node_id for r in nodes}) == 99
    assert {r.node_type for r in nodes if r.depth == 50} == {"Seq Scan", "Result"}
    assert all(r.parent_id == (r.node_id.rpartition(".")[0] or None) for r in nodes)
