"""Operator rules at their thresholds, on literal rows."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import bloat as B
from fleetgauge.operators import health as H
from fleetgauge.operators import layout as L
from fleetgauge.operators import maintenance as M
from fleetgauge.operators import performance as P
from fleetgauge.operators import replication as R
from fleetgauge.operators import sessions as S
from fleetgauge.sources.schemas import SCHEMAS

KEY = ("c0", "2024-01-10 00:00:00")


@pytest.fixture(scope="session")
def table(spark):
    """Rows of a telemetry table from dictionaries; missing columns are NULL."""

    def build(name, *rows, key=KEY):
        schema = SCHEMAS[name]
        text = ", ".join(f"{f.name} {'string' if f.dataType.simpleString() == 'timestamp' else f.dataType.simpleString()}" for f in schema.fields)
        data = [tuple({"cluster_id": key[0], "snapshot_ts": key[1], **r}.get(f.name) for f in schema.fields) for r in rows]
        df = spark.createDataFrame(data, text)
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    return build


def _settings(table, **values):
    return table("settings", *[{"name": n, "setting": v[0], "unit": v[1]} if isinstance(v, tuple) else {"name": n, "setting": v} for n, v in values.items()])


# --- health -------------------------------------------------------------------------------------


def test_mxid_status_order(table):
    ages = [10, 400_000_000, 399_999_999, 2_107_483_647, 2_117_483_647, 2_147_483_647]
    d = table("databases", *[{"datname": f"d{i}", "datallowconn": True, "mxid_age": a, "datminmxid": 1} for i, a in enumerate(ages)], {"datname": "z", "datallowconn": True, "mxid_age": 2_147_483_647, "datminmxid": 0}, {"datname": "no", "datallowconn": False, "mxid_age": 1, "datminmxid": 1})
    status = lambda limit: {r.datname: (r.status, r.remaining_to_autovacuum) for r in H.mxid_wraparound(d, _settings(table, autovacuum_multixact_freeze_max_age=limit)).collect()}
    normal = status("400000000")
    assert normal["d0"] == ("OK", 399_999_990)
    assert normal["d1"] == ("FORCE_AUTOVACUUM", 0)
    assert normal["d2"] == ("OK", 1)
    assert normal["d3"][0] == normal["d4"][0] == "FORCE_AUTOVACUUM"
    assert normal["d5"] == ("INVALID_OR_FROZEN", None)
    assert normal["z"] == ("FROZEN", None)
    assert "no" not in normal
    # With a larger limit the critical branch shows, and hides the warning branch behind it.
    high = status("2147483640")
    assert high["d3"][0] == high["d4"][0] == "CRITICAL"


def test_blocking_pairs_one_row_per_ungranted_lock(table):
    a = table("activity", {"pid": 1, "backend_type": "client backend", "blocking_pids": [2, 3]}, {"pid": 2, "backend_type": "client backend", "blocking_pids": []}, {"pid": 3, "backend_type": "autovacuum worker"}, {"pid": 4, "backend_type": "autovacuum worker", "blocking_pids": [2]})
    locks = table("locks", {"pid": 1, "granted": False}, {"pid": 1, "granted": False}, {"pid": 1, "granted": True}, {"pid": 4, "granted": False})
    got = sorted((r.waiting_pid, r.blocking_pid) for r in H.blocking_pairs(a, locks).collect())
    assert got == [(1, 2), (1, 2), (1, 3), (1, 3)]


def test_connection_security_classes(table):
    rows = [(True, True, "1"), (False, True, "1"), (None, None, None), (False, False, "1")]
    a = table("activity", *[{"pid": i, "backend_type": "client backend", "ssl": s, "gss_encrypted": g, "client_addr": c} for i, (s, g, c) in enumerate(rows)], {"pid": 9, "backend_type": "walsender"})
    got = {r.pid: (r.connection_type, r.ssl_version) for r in H.connection_security(a).collect()}
    assert got == {0: ("SSL", "N/A"), 1: ("GSSAPI", "N/A"), 2: ("local", "N/A"), 3: ("unencrypted", "N/A")}
    assert H.connection_security(a, limit=1).first().connection_type == "GSSAPI"


@pytest.mark.parametrize(("kind", "n", "hit"), [("Lock", 5, 0), ("Lock", 6, 1), ("IO", 10, 0), ("IO", 11, 1), ("BufferPin", 1, 1), ("LWLock", 50, 0)])
def test_wait_findings(table, kind, n, hit):
    a = table("activity", *[{"pid": i, "backend_type": "client backend", "state": "active", "wait_event_type": kind, "wait_event": "x"} for i in range(n)])
    assert H.wait_events(a)["findings"].count() == hit


@pytest.mark.parametrize(("used", "limit", "score", "pct"), [(90, 100, 70, 90.0), (91, 100, 30, 91.0), (75, 100, 100, 75.0), (76, 100, 70, 76.0), (1, 3, 100, 33.3)])
def test_check_connections(table, used, limit, score, pct):
    a = table("activity", *[{"pid": i} for i in range(used)])
    row = H.check_connections(a, _settings(table, max_connections=str(limit), superuser_reserved_connections="3")).first()
    assert (row.score, row.metric, row.second_metric) == (score, pct, 3.0)


def _at(table, day, **values):
    return table("settings", *[{"name": n, "setting": v} for n, v in values.items()], key=("c0", f"2024-01-{day:02} 00:00:00"))


def test_settings_count_as_of_the_moment(table):
    history = _at(table, 2, max_connections="80", autovacuum="off").unionAll(_at(table, 5, max_connections="100")).unionAll(_at(table, 9, autovacuum="on"))
    a = table("activity", {"pid": 1})
    for day in (1, 3, 5, 6, 12):
        a = a.unionAll(table("activity", {"pid": 1}, key=("c0", f"2024-01-{day:02} 07:00:00")))
    a = a.unionAll(table("activity", {"pid": 1}, key=("other", "2024-01-03 00:00:00")))
    # Before the first snapshot, and for a cluster without settings, the row stays and the limit is not known.
    got = {(r.cluster_id, r.snapshot_ts.day): r.max_connections for r in S.connection_usage(a, history).collect()}
    assert got == {("c0", 1): None, ("c0", 3): 80, ("c0", 5): 100, ("c0", 6): 100, ("c0", 10): 100, ("c0", 12): 100, ("other", 3): None}
    on = {(r.cluster_id, r.snapshot_ts.day): r.autovacuum_enabled for r in M.autovacuum_status(history, a)["summary"].collect()}
    assert [on["c0", d] for d in (1, 3, 6, 10, 12)] == [True, False, False, True, True] and on["other", 3] is True


def test_health_score_ignores_repeated_settings(table):
    a = table("activity", {"pid": 1})
    empty = [table(n) for n in ("tables", "locks", "replication", "databases", "bgwriter")]
    once = _at(table, 2, autovacuum="off", checkpoint_completion_target="0.5")
    again = once.unionAll(_at(table, 3, autovacuum="off", checkpoint_completion_target="0.5")).unionAll(_at(table, 4, autovacuum="off"))

    def score(settings):
        return [r.score for r in H.health_checks(a, *empty, settings).filter("check_name = 'settings'").collect()]

    assert score(once) == score(again) == [50]
    assert score(again.unionAll(_at(table, 9, autovacuum="on"))) == [90]
    # The newest values count where there is no moment to look up.
    assert S.connection_usage(a.drop("snapshot_ts"), _at(table, 2, max_connections="80").unionAll(_at(table, 5, max_connections="100")), keys=["cluster_id"]).first().max_connections == 100


def test_keyless_joins_are_no_cartesian_products(spark, table):
    t, s = table("tables", {"relkind": "r", "schemaname": "public", "relname": "t", "xid_age": 199_999_999, "mxid_age": 1, "relminmxid": 1}), _settings(table, autovacuum_freeze_max_age="200000000", autovacuum_multixact_freeze_max_age="400000000")
    d = table("databases", {"datname": "d", "temp_files": 1, "temp_bytes": 10})
    for out in (M.freeze_prediction(t, s, keys=[], settings_keys=[]), P.temp_file_usage(d, keys=[])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert out.count() == 1


def test_check_connections_needs_both_settings(table):
    a = table("activity", {"pid": 1})
    assert H.check_connections(a, _settings(table, max_connections="5")).count() == 0


@pytest.mark.parametrize(
    ("hh", "hr", "ih", "ir", "score"), [(90, 10, 95, 5, 100), (8999, 1001, 95, 5, 70), (90, 10, 9499, 501, 80), (0, 0, 0, 0, 50), (None, None, None, None, 50)]
)
def test_check_cache(table, hh, hr, ih, ir, score):
    t = table("tables", {"heap_blks_hit": hh, "heap_blks_read": hr, "idx_blks_hit": ih, "idx_blks_read": ir})
    assert H.check_cache(t).first().score == score


@pytest.mark.parametrize(("waiting", "blocked", "score"), [(0, 0, 100), (5, 0, 100), (6, 0, 80), (10, 0, 80), (11, 0, 60), (0, 1, 70), (11, 1, 30)])
def test_check_locks(table, waiting, blocked, score):
    locks = table("locks", {"pid": 0, "granted": True}, *[{"pid": i, "granted": False} for i in range(waiting)])
    a = table("activity", {"pid": 1}, *[{"pid": i, "wait_event_type": "Lock", "state": "active"} for i in range(blocked)])
    row = H.check_locks(locks, a).first()
    assert (row.score, row.metric, row.second_metric) == (score, waiting, blocked)


@pytest.mark.parametrize(("lag", "score"), [(0, 100), (10 * 2**20, 100), (10 * 2**20 + 1, 80), (100 * 2**20, 80), (100 * 2**20 + 1, 50)])
def test_check_replication(table, lag, score):
    r = table("replication", {"sent_lsn": f"0/{lag:X}", "replay_lsn": "0/0"}, {"sent_lsn": None, "replay_lsn": "0/0"})
    row = H.check_replication(r).first()
    assert (row.score, row.metric, row.second_metric) == (score, lag, 2)


def test_check_replication_without_replicas(table, spark):
    none = table("replication")
    keys = table("activity", {"pid": 1}).select("cluster_id", "snapshot_ts")
    row = H.check_replication(none, keys).first()
    assert (row.score, row.metric, row.second_metric) == (100, None, 0)


@pytest.mark.parametrize(("pct", "score"), [(50, 100), (50.01, 70), (75, 70), (75.01, 20)])
def test_check_wraparound(table, pct, score):
    age = round(2147483647 * pct / 100)
    d = table("databases", {"datname": "a", "xid_age": age}, {"datname": "template0", "xid_age": 2147483646})
    row = H.check_wraparound(d).first()
    assert (row.metric, row.score) == (pct, score)


@pytest.mark.parametrize(("timed", "req", "backend", "score"), [(90, 10, 0, 100), (89, 11, 0, 80), (0, 0, 0, 100), (90, 10, 20, 100), (90, 10, 21, 70), (0, 5, 21, 70)])
def test_check_bgwriter(table, timed, req, backend, score):
    row = {"checkpoints_timed": timed, "checkpoints_req": req, "buffers_checkpoint": 100 - backend, "buffers_clean": 0, "buffers_backend": backend, "stats_reset": "2024-01-09 00:00:00"}
    # Not one timed checkpoint reads as "unknown" and passes, unless that is switched off.
    assert H.check_bgwriter(table("bgwriter", row)).first().score == score
    if timed == 0 and req:
        assert H.check_bgwriter(table("bgwriter", row), zero_is_missing=False).first().score == score - 20


@pytest.mark.parametrize(("total", "score"), [(6 * 24, 100), (6 * 24 + 1, 70)])
def test_check_checkpoints(table, total, score):
    row = {"checkpoints_timed": total, "checkpoints_req": 0, "stats_reset": "2024-01-09 00:00:00"}
    assert H.check_checkpoints(table("bgwriter", row)).first().score == score


@pytest.mark.parametrize(
    ("name", "value", "unit", "score"),
    [
        ("shared_buffers", "16384", "8kB", 100), ("shared_buffers", "16383", "8kB", 80), ("work_mem", "4096", "kB", 100), ("work_mem", "4095", "kB", 90),
        ("effective_cache_size", "1", "8kB", 100), ("checkpoint_completion_target", "0.9", None, 100), ("checkpoint_completion_target", "0.89", None, 90),
        ("autovacuum", "on", None, 100), ("autovacuum", "off", None, 60), ("fsync", "off", None, 100),
    ],
)
def test_check_settings(table, name, value, unit, score):
    assert H.check_settings(_settings(table, **{name: (value, unit)})).first().score == score


def test_overall_bands(spark):
    rows = [("a", 90), ("a", 90), ("b", 89), ("b", 90), ("c", 70), ("d", 69), ("d", 70), ("e", 10)]
    d = spark.createDataFrame(rows, "k string, score long")
    got = {r.k: (r.overall_score, r.status) for r in H.overall_health(d, ["k"]).collect()}
    assert got == {"a": (90.0, "healthy"), "b": (89.5, "warning"), "c": (70.0, "warning"), "d": (69.5, "critical"), "e": (10.0, "critical")}


def _defs(spark, indexes):
    rows = [(*KEY, "public", t, n, list(c), 1, "d") for t, n, c in indexes]
    return spark.createDataFrame(rows, "cluster_id string, snapshot_ts string, schema_name string, table_name string, index_name string, columns array<string>, size_bytes long, definition string")


def test_duplicate_indexes_match_pairwise_definition(spark):
    rng = random.Random(2)
    indexes = [(f"t{rng.randrange(3)}", f"i{n:03d}", "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))) for n in range(120)]
    got = {(r.table_name, r.index1, r.index2, r.relationship) for r in H.duplicate_indexes(_defs(spark, indexes)).collect()}
    want = set()
    for (ta, a, ca), (tb, b, cb) in itertools.product(indexes, indexes):
        if ta == tb and a < b and ca[: len(cb)] == cb:
            want.add((ta, a, b, "duplicate" if ca == cb else "overlapping"))
    assert got == want and len(got) > 50


def test_duplicate_counts_are_the_pairs_without_making_them(spark):
    rng = random.Random(3)
    indexes = [(f"t{rng.randrange(3)}", f"i{n:03d}", "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))) for n in range(120)]
    defs = _defs(spark, [*indexes, indexes[0]])
    pairs = Counter(r.index2 for r in H.duplicate_indexes(defs).collect())
    counts = H.duplicate_counts(defs)
    got = Counter()
    for r in counts.collect():
        got[r.index_name] += r.pairs
    assert got == pairs and "Join" not in counts._jdf.queryExecution().executedPlan().toString()


def test_index_facts_read_the_indexes_once_and_count_as_the_lists(table, spark):
    one = {"schemaname": "public", "is_valid": True, "idx_scan": 0, "size_bytes": 5}
    rows = [
        one | {"relname": "t", "index_name": "a"},
        one | {"relname": "t", "index_name": "b", "is_valid": False},
        one | {"relname": "gone", "index_name": "c", "size_bytes": None},
        one | {"relname": "t", "index_name": "t_pkey"},
        one | {"relname": "t", "index_name": "d", "idx_scan": None, "is_valid": None},
    ]
    indexes = table("indexes", *rows)
    tables = table("tables", {"schemaname": "public", "relname": "t"}, {"schemaname": "public", "relname": "t"})
    sums = H.index_facts(indexes, tables).agg(*[F.sum(c).alias(c) for c in ("indexes", "invalid_indexes", "unused_indexes", "potential_savings_bytes")])
    unused = H.unused_indexes(indexes, tables)
    assert tuple(sums.first()) == (5, H.invalid_indexes(indexes).count(), unused.count(), unused.agg(F.sum("size_bytes")).first()[0]) == (5, 1, 4, 20)


def test_index_health_empty_scores_100(table, spark):
    healthy = table("indexes", {"schemaname": "public", "relname": "t", "index_name": "t_pkey", "is_valid": True, "idx_scan": 0, "size_bytes": 5})
    row = H.index_health(healthy, table("tables"), include_duplicates=False)["summary"].first()
    assert (row.score, row.invalid_indexes, row.unused_indexes) == (100, 0, 0)


# --- sessions -----------------------------------------------------------------------------------


def test_session_age_thresholds_are_strict(table):
    a = table(
        "activity",
        {"pid": 1, "state": "active", "backend_type": "client backend", "query_start": "2024-01-09 23:55:00"},
        {"pid": 2, "state": "active", "backend_type": "client backend", "query_start": "2024-01-09 23:54:59"},
        {"pid": 3, "state": "idle in transaction", "backend_type": "client backend", "xact_start": "2024-01-09 23:59:00"},
        {"pid": 4, "state": "idle in transaction", "backend_type": "client backend", "xact_start": "2024-01-09 22:59:59"},
        {"pid": 5, "state": None, "backend_type": "client backend", "xact_start": "2024-01-01 00:00:00"},
        {"pid": 6, "state": "idle", "backend_type": "client backend", "xact_start": "2024-01-01 00:00:00"},
    )
    assert [r.pid for r in S.long_running_queries(a).collect()] == [2]
    assert [(r.pid, r.transaction_seconds) for r in S.idle_in_transaction(a).collect()] == [(4, 3601)]
    assert [r.pid for r in S.long_running_transactions(a).collect()] == [4]


def test_active_session_filters(table):
    a = table(
        "activity",
        {"pid": 1, "state": "active", "backend_type": "client backend", "query": "SELECT 1", "datname": "a", "query_start": "2024-01-09 23:59:50"},
        {"pid": 2, "state": "idle", "backend_type": "client backend", "query": "SELECT 1", "datname": "a", "query_start": "2024-01-09 23:59:49"},
        {"pid": 3, "state": "active", "backend_type": "client backend", "query": "SELECT pg_catalog.x", "datname": "b", "query_start": "2024-01-09 23:00:00"},
        {"pid": 4, "state": "active", "backend_type": "client backend", "query": None, "datname": "b"},
        {"pid": 5, "state": "active", "backend_type": "walsender", "query": "x", "datname": None},
    )
    pids = lambda **k: sorted(r.pid for r in S.active_sessions(a, **k).collect())
    assert pids() == [1]
    assert pids(include_idle=True) == [1, 2]
    assert pids(include_system=True) == [1, 3, 4, 5]
    assert pids(include_idle=True, include_system=True, database="a", min_duration_seconds=10) == [1, 2]
    assert pids(include_idle=True, include_system=True, database="a", min_duration_seconds=11) == [2]
    assert {r.state: r["count"] for r in S.sessions_by_state(a).collect()} == {"active": 3, "idle": 1}


def test_lock_waiters_equals_brute_force_on_a_hot_object(table):
    """One object carries most locks; NULL-able keys, several modes, sessions without activity."""
    rng = random.Random(4)
    locks, known = [], set(range(0, 300, 1)) - {7, 11}
    for pid in range(300):
        for mode in rng.sample(["A", "B", "C"], rng.choice([1, 1, 2])):
            hot = rng.random() < 0.6
            locks.append({"pid": pid, "locktype": "relation", "database": 1, "relation": 99 if hot else rng.choice([None, 1, 2, 3]), "page": rng.choice([None, 4]) if not hot else None, "mode": mode, "granted": rng.random() < 0.5})
    a = table("activity", *[{"pid": p, "usename": f"u{p}", "query": f"q{p}"} for p in sorted(known)])
    for limit in (1, 5, 20, 60):
        want = []
        for w, o in itertools.product(locks, locks):
            if w["granted"] or w["pid"] == o["pid"] or w["pid"] not in known or o["pid"] not in known:
                continue
            if all(w[c] == o[c] for c in ("locktype", "database", "relation", "page")):
                want.append((w["pid"], o["pid"], w["mode"], o["mode"]))
        want = [p[:3] for p in sorted(want)[:limit]]
        got = S.lock_waiters(table("locks", *locks), a, limit=limit).collect()
        assert sorted((r.blocked_pid, r.blocking_pid, r.blocked_mode) for r in got) == sorted(want)


def test_lock_wait_graph_counts_pairs(table):
    rng = random.Random(6)
    locks = [{"pid": rng.randrange(30), "locktype": rng.choice(["relation", "tuple"]), "relation": rng.choice([None, 1, 1, 1, 2]), "tuple": rng.choice([None, 5]), "classid": rng.choice([None, 8]), "mode": rng.choice("AB"), "granted": rng.random() < 0.5} for _ in range(200)]
    a = table("activity", *[{"pid": p} for p in range(28)])
    known = [lock for lock in locks if lock["pid"] < 28]
    cols = ("locktype", "relation", "tuple", "classid")
    total = sum(1 for w, o in itertools.product(known, known) if w["pid"] != o["pid"] and all(w[c] == o[c] for c in cols))
    got = S.lock_wait_graph(table("locks", *locks), a).agg(F.sum("blocking_locks")).first()[0]
    assert got == total


# --- performance --------------------------------------------------------------------------------


def test_checkpointer_status(table):
    rows = [(1, 2, 3, 0, 0), (1, 3, 4, 0, 0), (0, 9, 9, 0, 0), (5, 0, 5, 10000, 0), (5, 0, 5, 10001, 0), (5, 0, 5, 0, 10001), (0, 0, 0, 7, 7)]
    c = table("checkpointer", *[{"num_timed": t, "num_requested": r, "num_done": d, "write_time_ms": w, "sync_time_ms": s, "buffers_written": i} for i, (t, r, d, w, s) in enumerate(rows)])
    got = {r.buffers_written: (r.checkpointer_status, r.avg_write_time_per_checkpoint_ms) for r in P.checkpointer_stats(c).collect()}
    assert [got[i][0] for i in range(7)] == ["OK", "WARNING", "OK", "OK", "WARNING", "WARNING", "OK"]
    assert got[4][1] == 2000.2 and got[6][1] == 0.0


def test_hotspots_put_unknown_scans_first(table):
    rows = [("a", 5, 1), ("b", 5, None), ("c", 9, 0), ("d", 1, None)]
    t = table("tables", *[{"schemaname": "s", "relname": n, "n_tup_ins": d, "n_tup_upd": 0, "n_tup_del": 0, "seq_scan": 3, "idx_scan": i} for n, d, i in rows])
    assert sorted(r.relname for r in P.table_hotspots(t, limit=2).collect()) == ["b", "c"]


def test_temp_share_counts_databases_below_the_threshold(table):
    d = table("databases", {"datname": "a", "temp_files": 30, "temp_bytes": 2 * 2**30}, {"datname": "b", "temp_files": 70, "temp_bytes": 5}, {"datname": "c", "temp_files": 0, "temp_bytes": 9 * 2**30})
    rows = P.temp_file_usage(d, threshold_gb=1).collect()
    assert [(r.datname, r.temp_files_ratio, r.temp_bytes_gb, r.temp_bytes_pretty) for r in rows] == [("a", 0.3, 2.0, "2048 MB")]


def test_progress_percentages_and_toast(table):
    p = table(
        "progress",
        {"operation": "analyze", "pid": 1, "blocks_total": 0, "blocks_scanned": 0},
        {"operation": "analyze", "pid": 2, "blocks_total": 3, "blocks_scanned": 1},
        {"operation": "vacuum", "pid": 3, "blocks_total": 0, "blocks_scanned": 0, "blocks_done": 0, "schemaname": "public", "relname": "t"},
        {"operation": "vacuum", "pid": 4, "blocks_total": 4, "blocks_scanned": 2, "blocks_done": 1, "schemaname": "public", "relname": "pg_toast_1"},
        {"operation": "vacuum", "pid": 5, "blocks_total": 4, "blocks_scanned": 2, "blocks_done": 1, "schemaname": "pg_catalog", "relname": "t"},
        {"operation": "vacuum", "pid": 6, "blocks_total": 4, "blocks_scanned": 2, "blocks_done": 1},
    )
    got = {r.pid: (r.scan_progress_pct, r.vacuum_progress_pct) for r in P.operation_progress(p, table("activity"))["operations"].collect()}
    assert got == {1: (None, None), 2: (33.33, None), 3: (0.0, 0.0)}
    with_toast = P.operation_progress(p, table("activity"), "vacuum", include_toast=True)
    assert sorted(r.pid for r in with_toast["operations"].collect()) == [3, 4]
    assert with_toast["summary"].first().total_count == 2


def test_table_findings_edges(table):
    base = {"schemaname": "public", "relkind": "r", "idx_scan": 0}
    t = table(
        "tables",
        {**base, "relname": "dead10", "n_live_tup": 1000, "n_dead_tup": 100, "seq_scan": 0},
        {**base, "relname": "dead11", "n_live_tup": 1000, "n_dead_tup": 101, "seq_scan": 0},
        {**base, "relname": "fresh", "n_live_tup": 1001, "n_dead_tup": 0, "seq_scan": 100, "last_autoanalyze": "2024-01-01 00:00:00"},
        {**base, "relname": "never", "n_live_tup": 1001, "n_dead_tup": 0, "seq_scan": 0},
        {**base, "relname": "scans", "n_live_tup": 10001, "n_dead_tup": 0, "seq_scan": 101, "last_analyze": "2024-01-01 00:00:00"},
    )
    got = sorted((r.subject, r.rule) for r in P.table_stats(t)["findings"].collect())
    assert got == [("dead11", "needs_vacuum"), ("never", "needs_analyze"), ("scans", "low_index_usage")]
    assert [r.table_name for r in P.table_report(t, table="DEAD10").collect()] == ["dead10"]


def test_table_order(table):
    rows = [("a", 5, None), ("b", 7, "2024-01-02 00:00:00"), ("c", None, "2024-01-03 00:00:00")]
    t = table("tables", *[{"schemaname": "public", "relkind": "r", "relname": n, "n_live_tup": v, "last_vacuum": lv, "total_size_bytes": i} for i, (n, v, lv) in enumerate(rows)])
    order = lambda by: [r.table_name for r in P.table_report(t).orderBy(*P.table_order(by)).collect()]
    assert order("rows") == ["c", "b", "a"]
    assert order("last_vacuum") == ["c", "b", "a"]
    assert order("anything") == order("size") == ["c", "b", "a"]


def test_table_io_zero_ratio_reads_as_unknown(table):
    t = table("tables", {"schemaname": "public", "relname": "t", "total_size_bytes": 2**31, "heap_blks_read": 5000, "heap_blks_hit": 0, "seq_scan": 9, "n_live_tup": 20000, "seq_tup_read": 1})
    row = P.table_io(t).first()
    assert (row.heap_hit_ratio, row.index_hit_ratio, row.seq_scan_ratio, row.total_physical_reads) == (100.0, 100.0, 100.0, 5000)
    assert P.table_io(t, zero_is_missing=False).first().heap_hit_ratio == 0.0
    assert sorted(r.rule for r in P.table_io_findings(P.table_io(t)).collect()) == ["index_missing", "sequential_scans"]


def test_statement_order_and_filters(table):
    rows = [(1, "SELECT 1", 10, 10_000), (2, "SELECT 2", 1, 9_000), (3, "SELECT pg_catalog.f()", 1, 10**9), (4, None, 1, 10**9), (5, "SELECT 5", 50, 100)]
    s = table("statements", *[{"queryid": i, "query": q, "calls": c, "total_exec_us": t, "rows_returned": -i} for i, q, c, t in rows])
    ids = lambda **k: sorted(r.queryid for r in P.top_statements(s, **k).collect())
    assert ids() == [1, 2, 5]
    assert ids(limit=1) == [2]
    assert ids(limit=1, order_by="calls") == [5]
    assert ids(limit=1, order_by="rows") == [1]
    assert ids(limit=1, order_by="nonsense") == [2]
    assert ids(min_mean_time_ms=1) == [1, 2]
    assert ids(min_calls=10) == [1, 5]


# --- replication and maintenance ----------------------------------------------------------------


def test_wal_directory_falls_back_to_a_tenth(table):
    a = table("archiver", {"archived_count": 1, "failed_count": 0})
    d = table("databases", {"datname": "a", "size_bytes": 105})
    none, some = table("wal_files"), table("wal_files", {"file_no": 1, "size": 2**24})
    assert R.wal_archiver_status(a, none, d).first().wal_directory_bytes == 11
    assert R.wal_archiver_status(a, some, d).first().wal_directory_size == "16 MB"


def test_freeze_status_order_and_limit(table):
    rows = [("over", 200_000_001, 0, 5), ("na", 150_000_001, 0, 0), ("mover", 0, 400_000_001, 5), ("crit", 180_000_001, 0, 5), ("warn", 150_000_001, 0, 5), ("fine", 150_000_000, 0, 5), ("mx", 0, 300_000_001, 5)]
    t = table("tables", *[{"schemaname": "public", "relkind": "r", "relname": n, "xid_age": x, "mxid_age": m, "relminmxid": z} for n, x, m, z in rows])
    s = _settings(table, autovacuum_freeze_max_age="200000000", autovacuum_multixact_freeze_max_age="400000000")
    got = {r.table_name: r.freeze_status for r in M.freeze_prediction(t, s).collect()}
    assert got == {"over": "XID_OVERDUE", "na": "MXID_NA", "mover": "MXID_OVERDUE", "crit": "CRITICAL", "warn": "WARNING", "mx": "OK"}
    # The status text decides who is cut: overdue ids sort last.
    assert "over" not in {r.table_name for r in M.freeze_prediction(t, s, limit=5).collect()}


def test_pending_vacuum_threshold(table):
    rows = [("eq", 1000, 4750), ("above", 1001, 4750), ("few", 999, 0)]
    t = table("tables", *[{"schemaname": "public", "relkind": "r", "relname": n, "n_dead_tup": d, "n_live_tup": live} for n, d, live in rows])
    s = _settings(table, autovacuum_vacuum_threshold="50", autovacuum_vacuum_scale_factor="0.2")
    got = {r.table_name: r.exceeds_threshold for r in M.pending_vacuum(t, s)["tables_needing_vacuum"].collect()}
    assert got == {"eq": False, "above": True}
    assert {r.table_name: r.status for r in M.autovacuum_trigger(t, s).collect()}["eq"] == "NEEDS VACUUM"


def test_vacuum_history_cuts_never_first(table):
    rows = [(f"t{i:02d}", "2024-01-09 12:00:00") for i in range(50)] + [("never", None)]
    t = table("tables", *[{"schemaname": "public", "relkind": "r", "relname": n, "last_vacuum": v} for n, v in rows])
    out = M.vacuum_history(t)
    # The list is cut, and never-vacuumed tables go first; the summary counts all tables.
    assert out["summary"].first().asDict()["total_tables"] == 51
    assert out["summary"].first().never_vacuumed == 1


def test_autovacuum_defaults_and_busy(table):
    a = table("activity", *[{"pid": i, "backend_type": "autovacuum worker", "query": "autovacuum: VACUUM x"} for i in range(3)])
    out = M.autovacuum_status(table("settings"), a)
    row = out["summary"].first()
    assert (row.autovacuum_enabled, row.max_workers, row.naptime_seconds, row.workers_available) == (True, 3, 60, 0)
    assert out["findings"].count() == 1
    assert M.autovacuum_status(_settings(table, autovacuum="off"), a)["summary"].first().autovacuum_enabled is False


def test_sequence_exhaustion_edge(table):
    s = table("sequences", *[{"sequence_name": f"s{v}{c}", "last_val": v, "max_val": 100, "seqcycle": c} for v in (80, 81, None) for c in (True, False)])
    assert [(r.last_val, r.percentage_used) for r in M.sequence_exhaustion(s).collect()] == [(81, 81.0)]


# --- bloat --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("dead", "free", "density", "severity"),
    [(10, 20, 70, "minimal"), (10.1, 20, 70, "moderate"), (30.1, 20, 70, "moderate"), (10.1, 20.1, 70, "high"), (30.1, 30.1, 70, "critical"), (30.1, 30.1, 49, "critical"), (0, 0, 49.9, "moderate"), (0, 20.1, 69.9, "high")],
)
def test_table_bloat_severity(table, dead, free, density, severity):
    s = table("heap_samples", {"schemaname": "public", "relname": "t", "table_len": 100, "dead_tuple_percent": float(dead), "free_percent": float(free), "tuple_percent": float(density), "dead_tuple_len": 1, "free_space": 2})
    row = B.bloat_metrics(s).first()
    assert (row.bloat_severity, row.wasted_space_bytes, row.wasted_percent) == (severity, 3, 3.0)


def test_table_bloat_totals_before_the_filter(table):
    rows = [("a", 6 * 2**30, 30), ("b", 6 * 2**30, 10), ("small", 5 * 2**30 - 1, 90)]
    s = table("heap_samples", *[{"schemaname": "public", "relname": n, "table_len": size, "free_space": size * p // 100, "tuple_percent": 80.0} for n, size, p in rows])
    out = B.table_bloat(s)
    row = out["summary"].first()
    assert (row.tables_analyzed, row.total_table_size, row.overall_wasted_percent) == (1, 12 * 2**30, 20.0)
    assert [r.table_name for r in out["tables"].collect()] == ["a"]


def test_toast_bloat_of_a_named_table(table):
    s = table("heap_samples", {"schemaname": "public", "relname": "t", "table_len": 10}, {"schemaname": "pg_toast", "relname": "pg_toast_1", "table_len": 7})
    t = table("tables", {"schemaname": "public", "relname": "t", "toast_relname": "pg_toast_1", "toast_size_bytes": 2048})
    row = B.table_bloat(s, t, table="t", include_toast=True)["toast"].first()
    assert (row.toast_table_name, row.toast_size_pretty, row.table_len) == ("pg_toast_1", "2.00 KB", 7)


@pytest.mark.parametrize(
    ("density", "pages", "severity", "bloat"),
    [(None, 0, "low", 0.0), (0.0, 0, "low", 0.0), (70.0, 0, "moderate", 20.0), (70.1, 0, "low", 19.9), (69.9, 21, "high", 20.1), (60.0, 0, "high", 30.0), (50.0, 0, "critical", 40.0), (49.0, 0, "critical", 41.0), (95.0, 31, "moderate", 0.0), (95.0, 21, "low", 0.0)],
)
def test_index_bloat_severity(table, density, pages, severity, bloat):
    s = table("index_samples", {"access_method": "btree", "avg_leaf_density": density, "leaf_pages": 100, "empty_pages": pages})
    row = B.btree_stats(s).first()
    assert (row.bloat_severity, row.estimated_bloat_percent) == (severity, bloat)


def test_index_bloat_of_a_table_keeps_other_methods(table):
    base = {"schemaname": "public", "relname": "t", "size_bytes": 6 * 2**30}
    s = table("index_samples", {**base, "index_name": "b1", "access_method": "btree", "avg_leaf_density": 90.0}, {**base, "index_name": "b2", "access_method": "btree", "avg_leaf_density": 45.0}, {**base, "index_name": "g", "access_method": "gin", "pending_tuples": 101}, {**base, "index_name": "h", "access_method": "hash", "dead_items": 100}, {**base, "index_name": "x", "access_method": "brin"})
    out = B.index_bloat(s, table="t")
    assert sorted(r.index_name for r in out["indexes"].collect()) == ["b2", "g", "h", "x"]
    assert out["summary"].first().indexes_analyzed == 5
    assert sorted(r.rule for r in out["findings"].collect()) == ["density_critical", "pending"]
    assert B.index_bloat(s, index="g")["findings"].first().rule == "pending"


# --- index advice -------------------------------------------------------------------------------


def test_unqualified_columns_need_a_single_table(spark):
    usage = spark.createDataFrame([("c", 1, None, "x"), ("c", 2, None, "y"), ("c", 2, "t", "z")], "cluster_id string, queryid long, table_name string, column_name string")
    tables = spark.createDataFrame([("c", 1, "a"), ("c", 1, "a"), ("c", 2, "t"), ("c", 2, "u")], "cluster_id string, queryid long, table_name string")
    got = sorted((r.queryid, r.table_name, r.column_name) for r in L.resolve_columns(usage, tables).collect())
    assert got == [(1, "a", "x"), (2, "t", "z")]


def test_candidates_and_filters_before_the_cut(spark):
    cols = spark.createDataFrame([("k", "t", c, n) for c, n in (("a", 1), ("b", 9), ("c", 5), ("d", 5))] + [("k", "u", "a", 1)], "k string, table_name string, column_name string, statements long")
    got = {(r.table_name, r["columns"]) for r in L.layout_candidates(cols, ["k"]).collect()}
    assert got == {("t", "a"), ("t", "b"), ("t", "c"), ("t", "d"), ("t", "b,c,d"), ("u", "a")}
    scored = spark.createDataFrame([("k", "T", "a", 50.0, "r"), ("k", "u", "b", 40.0, "r"), ("k", "t", "c", 9.9, "r")], "k string, table_name string, columns string, estimated_improvement_percent double, reason string")
    pick = lambda **k: [r["columns"] for r in L.recommend_layout(scored, keys=["k"], **k).collect()]
    assert sorted(pick()) == ["a", "b"]
    assert pick(max_recommendations=1, tables=["u"]) == ["b"]
    assert pick(tables=["t"]) == ["a"]


def test_estimated_sizes(spark):
    """Entries of 12 bytes and the columns, aligned to eight; 7336 bytes of a page are filled."""
    found = spark.createDataFrame([("c", "t", "a"), ("c", "t", "a,b"), ("c", "t", "a,x"), ("c", "u", "a"), ("c", "e", "a")], "cluster_id string, table_name string, columns string")
    widths = spark.createDataFrame([("c", t, n, w) for t in "tue" for n, w in (("a", 4), ("b", 9))], "cluster_id string, table_name string, column_name string, avg_width long")
    rows = spark.createDataFrame([("c", "t", 1_000_000), ("c", "e", 0)], "cluster_id string, table_name string, row_count long")
    got = {(r.table_name, r["columns"]): r.estimated_size_bytes for r in L.estimated_sizes(found, widths, rows).collect()}

    def pages(n, width):
        held = 7336 // (12 + -(-width // 8) * 8)
        leaves = max(1, -(-n // held))
        return 1 + leaves + (-(-leaves // held) if leaves > 1 else 0)

    assert got == {("t", "a"): 8192 * pages(10**6, 4), ("t", "a,b"): 8192 * pages(10**6, 13), ("t", "a,x"): None, ("u", "a"): None, ("e", "a"): 8192 * 2}


def test_own_statements_as_workload(spark):
    rows = [("c", 1, 1, 10, "DELETE FROM t"), ("c", 2, 100, 10**9, "SELECT 1"), ("d", 1, 1, 1, "SELECT 2")]
    st = spark.createDataFrame(rows, "cluster_id string, queryid long, calls long, total_exec_us long, query string")
    own = spark.createDataFrame([(1,), (1,)], "queryid long")
    assert sorted(map(tuple, L.workload_statements(st, keys=["cluster_id"], own=own).collect())) == [("c", 1), ("d", 1)]
    assert [r.queryid for r in L.workload_statements(st, keys=["cluster_id"], limit=None).collect()] == [2]


# --- without keys -------------------------------------------------------------------------------


def test_no_keys_equals_the_one_key_slice(table):
    t = table("tables", *[{"schemaname": "public", "relkind": "r", "relname": f"t{i}", "n_tup_ins": i, "n_tup_upd": 0, "n_tup_del": 0, "seq_scan": 1, "idx_scan": 1, "n_dead_tup": 2000 + i, "n_live_tup": 10, "heap_blks_hit": 5, "heap_blks_read": 5} for i in range(9)])
    s = _settings(table, autovacuum_vacuum_threshold="50")
    one = [r.asDict() for r in P.table_hotspots(t).collect()]
    none = [r.asDict() for r in P.table_hotspots(t, keys=[]).collect()]
    assert sorted(r["relname"] for r in one) == sorted(r["relname"] for r in none)
    assert P.buffer_pool_io(t, keys=[]).first().heap_hit_ratio == P.buffer_pool_io(t).first().heap_hit_ratio == 50.0
    need = M.tables_needing_vacuum(t, s, keys=[], settings_keys=[])
    assert need.count() == M.tables_needing_vacuum(t, s).count() == 9


def test_interval_mode_takes_any_keys(spark):
    """Series are told by the keys but for the time; each has resets of its own, and one moment alone has no growth."""
    from fleetgauge.operators.performance import io_statistics, wal_statistics

    rows = [(r, f"2024-01-0{d}", "db", n) for r, values in (("eu", (10, 30, 5)), ("us", (100, 90, 95))) for d, n in enumerate(values, 1)]
    df = spark.createDataFrame(rows, "region string, t string, datname string, wal_records long").withColumn("snapshot_ts", F.col("t").cast("timestamp"))
    df = df.withColumns({c: F.col("wal_records") * 2 for c in ("wal_fpi", "wal_bytes", "wal_buffers_full")})
    got = sorted((r.region, r.wal_records, r.wal_fpi) for r in wal_statistics(df, ["region", "snapshot_ts"], mode="interval").collect())
    assert got == [("eu", 5, 10), ("eu", 20, 40), ("us", 5, 10), ("us", 90, 180)]
    one = df.filter("region = 'eu'").drop("region")
    assert sorted(r.wal_records for r in wal_statistics(one, keys=[], mode="interval").collect()) == [5, 20]
    with pytest.raises(ValueError, match="snapshot_ts"):
        wal_statistics(df.drop("snapshot_ts"), keys=["region"], mode="interval")
    context = df.select("region", "snapshot_ts", F.lit("client").alias("backend_type"), F.lit("relation").alias("object"), F.lit("normal").alias("context"), F.col("wal_records").alias("reads"), (F.col("wal_records") * 8).alias("read_bytes"))
    databases = df.select("region", "snapshot_ts", "datname", *[F.col("wal_records").alias(c) for c in ("temp_files", "temp_bytes", "blks_read", "blks_hit", "blk_read_time", "blk_write_time")])
    found = io_statistics(databases, context, mode="interval", keys=["region", "snapshot_ts"])
    assert sorted((r.region, r.reads, r.read_bytes_pretty) for r in found["by_context"].collect()) == [("eu", 5, "40 bytes"), ("eu", 20, "160 bytes"), ("us", 5, "40 bytes"), ("us", 90, "720 bytes")]
    assert found["database"].count() == 4


def test_progress_views_have_their_own_columns(table):
    from fleetgauge.sources.schemas import SCHEMAS

    p = table("progress", {"operation": "vacuum", "pid": 1, "schemaname": "public", "relname": "t", "num_dead_tuples": 7}, {"operation": "create_index", "pid": 2, "relname": "t", "command": "REINDEX", "tuples_done": 3}, {"operation": "vacuum", "pid": 3, "schemaname": "public"})
    out = P.operation_progress(p, table("activity"), include_toast=True)
    assert [(r.pid, r.num_dead_tuples) for r in out["vacuum"].collect()] == [(1, 7)]
    assert [(r.pid, r.command, r.tuples_done, r.partitions_done) for r in out["create_index"].collect()] == [(2, "REINDEX", 3, None)]
    assert out["cluster"].count() == 0 and set(P.PROGRESS_COLUMNS) == set(P.PROGRESS_OPERATIONS)
    # A progress table as collected by an older version lacks the newer columns.
    old = p.drop("command", "tuples_done", "num_dead_tuples")
    assert P.operation_progress(old, table("activity"), "vacuum")["vacuum"].schema == out["vacuum"].schema
    assert set(P.operation_progress(p, table("activity"), "create-index")) == {"create_index", "operations", "summary"}
    with pytest.raises(ValueError):
        P.operation_progress(p, table("activity"), "reindex")
    assert {"delay_time", "cluster_index_relid"} <= {f.name for f in SCHEMAS["progress"].fields}
