"""One key with a third of all rows: joins are split at run time, results stay whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import health as H
from fleetgauge.operators import sessions as S

ROWS = 60_000


@pytest.fixture
def small_partitions(spark):
    """Thresholds at which the test rows count as skewed."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _keyed(df):
    return df.select(F.lit("c").alias("cluster_id"), F.lit("2024-01-01").cast("timestamp").alias("snapshot_ts"), "*")


def _activity(spark):
    stamp = F.lit("2023-12-31 23:00:00").cast("timestamp")
    return _keyed(
        spark.range(0, ROWS, 1, 8).select(
            F.col("id").alias("pid"),
            F.lit("client backend").alias("backend_type"),
            F.concat(F.lit("u"), F.col("id")).alias("usename"),
            F.sha2(F.col("id").cast("string"), 512).alias("query"),
            stamp.alias("query_start"),
        )
    )


def _final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_one_blocker_of_a_third_of_all_sessions(small_partitions):
    spark = small_partitions
    activity = _activity(spark)
    pid = F.col("id")
    edges = _keyed(
        spark.range(1, ROWS, 1, 8).select(pid.alias("pid"), F.when(pid % 3 == 0, F.lit(0)).otherwise(pid - 1).cast("long").alias("blocking_pid"))
    )
    locks = _keyed(spark.range(1, ROWS, 1, 8).select(pid.alias("pid"), F.lit(False).alias("granted")))
    rows, plan = _final_plan(H.blocking_pairs(activity, locks, edges))
    assert len(rows) == ROWS - 1
    assert sum(r.blocking_pid == 0 for r in rows) == len(range(3, ROWS, 3)) + 1
    assert "skew=true" in plan


def test_one_object_with_a_third_of_all_locks(small_partitions):
    spark = small_partitions
    pid = F.col("id")
    null = F.lit(None).cast("long")
    locks = _keyed(
        spark.range(0, ROWS, 1, 8).select(
            pid.alias("pid"),
            F.lit("relation").alias("locktype"),
            F.lit(1).cast("long").alias("database"),
            F.when(pid % 3 == 0, F.lit(7)).otherwise(pid + 100).cast("long").alias("relation"),
            *[null.alias(c) for c in ("page", "tuple", "transactionid")],
            F.lit(None).cast("string").alias("virtualxid"),
            F.lit("m").alias("mode"),
            (pid % 6 != 0).alias("granted"),
        )
    )
    hot = ROWS // 3
    rows, _ = _final_plan(S.lock_wait_graph(locks, _activity(spark)))
    assert len(rows) == hot and {r.blocking_locks for r in rows} == {hot - 1}
    waiters, plan = _final_plan(S.lock_waiters(locks, _activity(spark), limit=20))
    assert sorted((r.blocked_pid, r.blocking_pid) for r in waiters) == [(0, 3 * i) for i in range(1, 21)]
    assert "WindowGroupLimit" in plan


def test_index_classes_of_a_hot_table(small_partitions):
    """A third of all indexes share one list on one table; the result has one row per index, as brute force has it."""
    spark = small_partitions
    hot, n = 2000, 6000
    lists = [["a"], ["a", "b"], ["a", "b", "c"], ["b"], ["a", "c"], ["b", "a", "c", "d"]]
    rows = [("public", "t", f"i{i:05d}", ["a", "b"] if i < hot else lists[i % 6], "x" * 50, i) for i in range(n)]
    rows += [("public", "u", "only", ["a", "b", "c"], "d", 1), ("audit", "t", "other", ["a"], "d", 1), ("public", "u", "none", [], "d", 1)]
    defs = _keyed(spark.createDataFrame(rows, "schema_name string, table_name string, index_name string, columns array<string>, definition string, size_bytes long"))
    found = H.index_classes(defs).collect()
    assert len(found) == n + 1
    groups = {}
    for schema, table, name, columns, *_ in rows:
        if schema == "public" and columns:
            groups.setdefault((table, tuple(columns)), []).append(name)
    lead = {g: max((o for o in groups if o[0] == g[0] and len(o[1]) < len(g[1]) and g[1][: len(o[1])] == o[1]), key=lambda o: len(o[1]), default=None) for g in groups}
    for r in found:
        g = (r.table_name, tuple(r.columns.split(",")))
        first, above = min(groups[g]), sum(v == g for v in lead.values())
        kind = "duplicate" if r.index_name != first else "leading" if above else "single"
        assert (r.class_size, r.representative, r.extended_by, r.relationship) == (len(groups[g]), first, above, kind)
        assert r.extends == (min(groups[lead[g]]) if lead[g] else None)
