"""Ordered streams: growth and episodes in event-time order, late rows, timers, expiry, and the closing run."""

from __future__ import annotations

import datetime as dt

import pytest

from fleetgauge.functions.frames import Rule, text
from fleetgauge.session import shared_dir
from fleetgauge.streaming import live
from fleetgauge.streaming.ordered import Series
from pyspark.sql import functions as F
from tests.test_plans import _new_dir

SCHEMA = "cluster_id string, name string, snapshot_ts timestamp, n long, m double"


class Feed:
    """A stream of one file per batch, and the deltas over it."""

    def __init__(self, spark, **options):
        self.spark, (self.root, self.out, self.mark) = spark, [_new_dir(spark) for _ in range(3)]
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/*")
        options = {"lateness": dt.timedelta(minutes=5)} | options
        self.deltas = live.counter_deltas(stream, ["cluster_id", "name"], ["n", "m"], **options)

    def batch(self, i, *rows):
        data = [("c", name, m if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), n, None if n is None else n / 2) for name, m, n in rows]
        self.spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{self.root}/day={i}")

    def run(self):
        self.deltas.start(self.out, self.mark, once=True).awaitTermination(120)

    def close(self):
        self.deltas.close(self.out, self.mark)

    def rows(self):
        minutes = lambda t: int((t - dt.datetime(2024, 1, 1)).total_seconds() // 60)
        found = self.deltas.growth(self.out).collect()
        assert all(r.m == (None if r.n is None else r.n / 2) for r in found)
        return sorted(((r.name, minutes(r.interval_start), minutes(r.interval_end), r.n) for r in found), key=lambda r: (r[0] or "", *r[1:3]))

    def late(self):
        return sorted((r.name, r.snapshot_ts.hour * 60 + r.snapshot_ts.minute, r.n) for r in self.deltas.late(self.out).collect())


def test_growth_comes_in_event_time_order(spark):
    feed = Feed(spark)
    feed.batch(1, ("a", 0, 10), ("a", 2, 30), ("b", 1, 7), ("b", None, 99))
    feed.batch(2, ("a", 1, 20), ("a", 3, 5), ("a", 3, 5))
    feed.batch(3, ("a", 30, 100))
    feed.run()
    settled = [("a", 0, 1, 10), ("a", 1, 2, 10), ("a", 2, 3, 5)]
    assert feed.rows() == settled and feed.late() == []
    # The closing run gives the tail; the stream goes on from the same state and withdraws it.
    feed.close()
    assert feed.rows() == [*settled, ("a", 3, 30, 95)]
    feed.close()
    assert feed.rows() == [*settled, ("a", 3, 30, 95)]
    feed.batch(4, ("a", 29, 90), ("a", 1, 50), ("a", 40, 130), ("b", 41, 9))
    feed.run()
    assert feed.rows() == [*settled, ("a", 3, 29, 85), ("a", 29, 30, 10)]
    assert feed.late() == [("a", 1, 50)]
    feed.batch(5, ("b", 59, 10))
    feed.run()
    # A series that receives nothing more is settled by a timer.
    assert feed.rows() == [*settled, ("a", 3, 29, 85), ("a", 29, 30, 10), ("a", 30, 40, 30), ("b", 1, 41, 2)]
    feed.close()
    assert feed.rows()[-1] == ("b", 41, 59, 1) and feed.late() == [("a", 1, 50)]


def test_all_growth_is_that_of_a_plain_lag(spark):
    """In any order of arrival within the lateness, over several batches, with nulls and resets, nothing is lost."""
    import random

    rng = random.Random(5)
    feed = Feed(spark, lateness=dt.timedelta(minutes=500))
    rows = [(name, m, rng.choice((None, *range(50)))) for name in ("a", "b", None, "hot") for m in rng.sample(range(400), 300 if name == "hot" else 20)]
    rng.shuffle(rows)
    for i in range(3):
        feed.batch(i, *rows[i::3])
    feed.run()
    feed.close()
    want = []
    for name in ("a", "b", None, "hot"):
        series = sorted((m, n) for s, m, n in rows if s == name)
        for (m0, n0), (m1, n1) in zip(series, series[1:]):
            want.append((name, m0, m1, n1 if n1 is None or n0 is None or n1 < n0 else n1 - n0))
    assert sorted(feed.rows(), key=repr) == sorted(want, key=repr) and feed.late() == []


def test_a_silent_series_expires(spark):
    feed = Feed(spark, expiry=dt.timedelta(minutes=60))
    feed.batch(1, ("a", 0, 1), ("b", 0, 1))
    feed.batch(2, ("b", 30, 2))
    feed.batch(3, ("b", 200, 5))
    feed.run()
    feed.batch(4, ("a", 201, 9), ("b", 201, 6))
    feed.run()
    feed.close()
    # a was forgotten, so its second snapshot starts anew; so does b's third, an hour and more after its second.
    assert ("a", 0, 201, 8) not in feed.rows() and ("b", 0, 30, 1) in feed.rows() and ("b", 200, 201, 1) in feed.rows()


def test_rows_of_one_instant_stay_together():
    """The least row counts as a whole, not the least of each column."""
    series = Series(None)
    for row in ('{"a":2,"b":1}', '{"a":1,"b":5}', '{"a":1,"b":5}'):
        assert series.take(7, row)
    visits = list(series.settle(7, lambda carried, t, values: (t, values)))
    assert visits == [(7, {"a": 1, "b": 5})] and not series.take(7, "{}") and Series(series.dump()).settled_at == 7


@pytest.mark.parametrize("quiet", [None, 45])
def test_one_alert_per_episode(spark, quiet):
    root, out, mark = [_new_dir(spark) for _ in range(3)]
    schema = "cluster_id string, snapshot_ts timestamp, name string, load int"

    def batch(i, *rows):
        data = [("c", dt.datetime(2024, 1, 1, m // 60, m % 60), name, load) for name, m, load in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{root}/day={i}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/*")
    rule = Rule("busy", F.col("load") > 5, "warning", F.col("name"), F.col("load"), text("load ", F.col("load")))
    alerts = live.episodes(stream, rule, quiet=None if quiet is None else dt.timedelta(minutes=quiet))
    batch(1, ("x", 0, 9), ("x", 20, 8), ("y", 0, 1), ("x", 10, 7))
    batch(2, ("x", 20, 8), ("x", 30, 2), ("y", 30, 6), ("x", 40, 9), ("x", 40, 9))
    batch(3, ("x", 100, 9), ("y", 100, None), ("y", 110, 7))
    alerts.start(out, mark, once=True).awaitTermination(120)
    alerts.close(out, mark)
    found = sorted((r.subject, r.snapshot_ts.hour * 60 + r.snapshot_ts.minute, r.metric, r.message) for r in alerts.alerts(out).collect())
    want = [("x", 0, 9.0, "load 9"), ("x", 40, 9.0, "load 9"), ("y", 30, 6.0, "load 6"), ("y", 110, 7.0, "load 7")]
    assert found == sorted(want + ([("x", 100, 9.0, "load 9")] if quiet else []))
    assert alerts.alerts(out).columns == ["cluster_id", "snapshot_ts", "source", "rule", "severity", "subject", "metric", "message"]
    assert shared_dir(spark)


def test_settling_ranks_only_differing_rows_of_one_instant(monkeypatch):
    """Rows alone at their instant, and repeats of one row, are not decoded to be ranked; of differing rows the least counts."""
    from fleetgauge.streaming import ordered as O

    ranked, rank = [], O._rank
    monkeypatch.setattr(O, "_rank", lambda row: ranked.append(row) or rank(row))
    series = O.Series(None)
    for t, row in [(3, '{"n":5}'), (1, '{"n":9}'), (2, '{"n":4}'), (2, '{"n":4}'), (3, '{"n":null}'), (3, '{"n":10}')]:
        assert series.take(t, row)
    got = list(series.settle(None, lambda carried, t, values: (None, values)))
    assert got == [(1, {"n": 9}), (2, {"n": 4}), (3, {"n": None})]
    assert sorted(ranked) == ['{"n":10}', '{"n":5}', '{"n":null}']
