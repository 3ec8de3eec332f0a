"""Frame helpers: top-n, findings, spine, interval growth, joins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.functions import frames as X

TS = "timestamp '2024-01-{:02d} {:02d}:00:00'"


def _series(spark, rows):
    df = spark.createDataFrame(rows, "cluster_id string, name string, t string, n long, m long")
    return df.withColumn("snapshot_ts", F.col("t").cast("timestamp")).drop("t")


def test_topn_matches_sorted_slice(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", rng.choice([None, *range(5)]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, id int").repartition(7)
    got = X.topn(df, 4, [F.desc_nulls_first("v"), F.asc("id")], ["k"]).collect()
    want = []
    for k in {d[0] for d in data}:
        rows = sorted((d for d in data if d[0] == k), key=lambda d: (d[1] is not None, -(d[1] or 0), d[2]))
        want += rows[:4]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_topn_without_keys(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 10)
    rows = X.topn(df, 3, [F.desc("v"), F.asc("id")], []).collect()
    assert [r.id for r in rows] == [9, 19, 29]


def test_topn_cuts_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = X.topn(df, 2, [F.asc("id")], ["k"])._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before_shuffle


def test_findings_one_row_per_matching_rule(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("c", None)], "k string, v int")
    rules = [
        X.Rule("pos", F.col("v") > 0, "info", F.col("k"), F.col("v"), X.text("v is ", F.col("v"))),
        X.Rule("big", F.col("v") > 3, "high", F.col("k"), F.col("v"), X.text("big")),
    ]
    got = sorted(tuple(r) for r in X.findings(df, "s", rules, ["k"]).collect())
    assert got == [
        ("a", "s", "pos", "info", "a", 1.0, "v is 1"),
        ("b", "s", "big", "high", "b", 5.0, "big"),
        ("b", "s", "pos", "info", "b", 5.0, "v is 5"),
    ]


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, None, "x"), (1, 2, "y")], "p int, q int, v string")
    b = spark.createDataFrame([(1, None, "m"), (1, 3, "n")], "p int, q int, w string")
    assert [tuple(r) for r in X.null_safe_join(a, b, ["p", "q"]).collect()] == [(1, None, "x", "m")]


def test_first_names_cuts_and_counts(spark):
    df = spark.createDataFrame([("k", f"n{i:02d}", i) for i in range(12)] + [("j", "only", 1)], "k string, name string, v int")
    got = {r.k: (r.n, r.names) for r in X.first_names(df, "name", [F.desc("v")], ["k"], 3).collect()}
    assert got == {"k": (12, "n11, n10, n09"), "j": (1, "only")}
    assert X.first_names(df, "name", [F.desc("v"), F.asc("name")], [], 2).first().names == "n11, n10"


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_interval_deltas_match_a_plain_lag(spark, bucket):
    rng = random.Random(5)
    rows = []
    for name, steps in (("hot", 300), ("a", 20), (None, 10), ("single", 1)):
        n = 100
        for i in sorted(rng.sample(range(24 * 28), steps)):
            n = rng.randrange(0, 50) if rng.random() < 0.1 else n + rng.randrange(0, 9)
            m = None if rng.random() < 0.1 else n * 2
            rows.append(("c", name, f"2024-01-{i // 24 + 1:02d} {i % 24:02d}:00:00", n, m))
    df = _series(spark, rows).repartition(5)
    got = X.interval_deltas(df, ["name"], ["n", "m"], bucket=bucket)
    want = []
    for name in ("hot", "a", None, "single"):
        mine = [r for r in rows if r[1] == name]
        for before, now in zip(mine, mine[1:]):
            grown = []
            for i in (3, 4):
                b, v = before[i], now[i]
                grown.append(v if b is None or v is None or v < b else v - b)
            want.append((name, now[2], before[2], *grown))
    seen = [
        (r["name"], str(r.snapshot_ts), str(r.interval_start), r.n, r.m) for r in got.select("name", "snapshot_ts", "interval_start", "n", "m").collect()
    ]
    assert sorted(seen, key=repr) == sorted(want, key=repr)


def test_interval_deltas_keep_first(spark):
    df = _series(spark, [("c", "a", "2024-01-01 00:00:00", 5, 5), ("c", "a", "2024-01-02 00:00:00", 3, 9)])
    got = X.interval_deltas(df, ["name"], ["n", "m"], keep_first=True).orderBy("snapshot_ts").collect()
    assert [(r.n, r.m) for r in got] == [(5, 5), (3, 4)]


def test_spine(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(r.k for r in X.spine([a, b], ["k"]).collect()) == [1, 2, 3]


def test_unknown_mode(spark):
    from fleetgauge.operators.performance import rollback_rate

    with pytest.raises(ValueError):
        rollback_rate(spark.range(1), mode="hourly")


@pytest.mark.parametrize("seed", range(3))
def test_settings_in_force_match_a_look_back(spark, seed):
    """Intervals of changes give every row the newest value at or before it, also with gaps, repeats and several changes a day."""
    rng = random.Random(seed)
    history = [(c, f"2024-01-{rng.randint(2, 6):02d} {rng.randint(0, 23):02d}:00:00", rng.choice("ab"), rng.choice(("1", "1", "2", None)), None) for c in ("x", "y") for _ in range(40)]
    history = list({h[:3]: h for h in history}.values()) + [("z", "2024-01-03 00:00:00", "other", "9", "kB")]
    moments = [(c, f"2024-01-{d:02d} {h:02d}:30:00", i) for c in ("x", "y", "z", "none", None) for d in range(1, 8) for h in (0, 7, 13, 23) for i in (1, 2)]
    cast = F.col("t").cast("timestamp").alias("snapshot_ts")
    settings = spark.createDataFrame(history, "cluster_id string, t string, name string, setting string, unit string").withColumn("snapshot_ts", cast).drop("t")
    rows = spark.createDataFrame(moments, "cluster_id string, t string, i int").withColumn("snapshot_ts", cast)
    got = {(r.cluster_id, r.t, r.i): (r.a, r.b, r["_known"]) for r in X.with_settings(rows, settings, ["a", "b"]).collect()}
    assert len(got) == len(moments)
    for c, t, i in moments:
        seen = sorted(h for h in history if h[0] == c and h[1] <= t)
        newest = {n: next((h[3] for h in reversed(seen) if h[2] == n and h[3] is not None), None) for n in "ab"}
        assert got[c, t, i] == (newest["a"], newest["b"], bool(seen))
    found = X.settings_in_force(settings, ["a", "b"])
    assert found.frame.filter("_to <= _from").count() == 0 and found.frame.filter("cluster_id = 'x'").count() <= len({h[1] for h in history if h[0] == "x"})


def test_unchanged_settings_make_one_interval(spark):
    settings = spark.range(500).select(F.lit("c").alias("cluster_id"), F.timestamp_seconds(F.col("id") * 7200).alias("snapshot_ts"), F.lit("a").alias("name"), F.lit("1").alias("setting"), F.lit(None).cast("string").alias("unit"))
    assert X.settings_in_force(settings, ["a"]).frame.count() == 1
    rows = spark.range(3).select(F.timestamp_seconds(F.col("id")).alias("snapshot_ts"))
    assert [r.a for r in X.with_settings(rows, settings.drop("cluster_id"), ["a"], ["snapshot_ts"], []).collect()] == ["1"] * 3
