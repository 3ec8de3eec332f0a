"""Building blocks on DataFrames: top-n per key, findings, settings lookup, keyed joins."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import KEYS

FINDING_COLUMNS = ("source", "rule", "severity", "subject", "metric", "message")


def topn(df: DataFrame, n: int | None, order: Sequence[Column], keys: Sequence[str] = KEYS) -> DataFrame:
    """The first ``n`` rows per key; all rows for ``None``.

    ``row_number() <= n`` lets Spark cut every map partition to ``n`` rows per key before the
    shuffle, so a key holding a third of the data still ships only ``n`` rows per task.
    """
    if n is None:
        return df
    if not keys:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on key names. Without keys the right side is one aggregate row, which is broadcast: its one key would be hot."""
    if on:
        return left.join(right, list(on), how)

    # Zero for every row, but no constant: a constant key would be folded away and leave a Cartesian product.
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_one", F.pmod(F.hash(df.columns[0]), F.lit(1)))

    return keyed(left).join(F.broadcast(keyed(right)), "_one", how).drop("_one")


def null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal or both-NULL columns, keeping the left copy; stays hash- and sort-joinable."""
    other = {c: f"_right_{c}" for c in cols}
    on = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(r)) for c, r in other.items()])
    return left.join(right.withColumnsRenamed(other), on, how).drop(*other.values())


@dataclass(frozen=True)
class Rule:
    """One row of advice for every input row that satisfies ``when``."""

    name: str
    when: Column
    severity: str
    subject: Column
    metric: Column
    message: Column


def text(*parts: Column | str) -> Column:
    """Concatenate literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def findings(df: DataFrame, source: str, rules: Sequence[Rule], keys: Sequence[str] = KEYS) -> DataFrame:
    """Evaluate all rules in one pass over ``df``; rows matching none vanish."""
    cells = [
        F.when(
            r.when,
            F.struct(
                F.lit(source).alias("source"),
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
                r.subject.cast("string").alias("subject"),
                r.metric.cast("double").alias("metric"),
                r.message.cast("string").alias("message"),
            ),
        )
        for r in rules
    ]
    hits = F.filter(F.array(*cells), lambda cell: cell.isNotNull())
    return df.select(*keys, F.explode(hits).alias("_f")).select(*keys, "_f.*")


@dataclass(frozen=True)
class Settings:
    """Settings by validity: one (setting, unit) struct per name, ``_known``, and with ``timed`` the instants ``_from`` and ``_to``."""

    frame: DataFrame
    keys: list[str]
    time_col: str
    timed: bool

    def own_keys(self) -> list[str]:
        """What tells the rows of ``frame`` apart."""
        return [*self.keys, "_from"] if self.timed else self.keys

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns in force at each row; all rows stay."""
        if not self.timed:
            return keyed_join(df, self.frame, self.keys, "left")
        # Without keys, a key that is zero for every row, but no constant (see keyed_join).
        keys, extra = self.keys, {}
        if not keys:
            keys, extra = ["_one"], {"_one": F.pmod(F.hash(self.time_col), F.lit(1))}
        other = self.frame if self.keys else self.frame.withColumn("_one", F.pmod(F.hash("_from"), F.lit(1)))
        renamed = {k: f"_of_{k}" for k in keys}
        left, now = df.withColumns(extra) if extra else df, F.col(self.time_col)
        on = functools.reduce(lambda x, y: x & y, [F.col(k) == F.col(r) for k, r in renamed.items()])
        on = on & (now >= F.col("_from")) & (F.col("_to").isNull() | (now < F.col("_to")))
        return left.join(other.withColumnsRenamed(renamed), on, "left").drop(*renamed.values(), *extra, "_from", "_to")


def settings_in_force(
    settings: DataFrame, names: Sequence[str], keys: Sequence[str] = KEYS, settings_keys: Sequence[str] = ("cluster_id",), time_col: str = "snapshot_ts"
) -> Settings:
    """The settings of a history as intervals in which nothing changes, to be met by rows of ``keys``.

    A snapshot that repeats what was in force makes no interval, so there are as many as changes, and rows meet them by an equi-join
    with a range. Unchanged snapshots are dropped per (keys, day) first: only the first of a day and changes are ordered per key.
    Without times there is one value, and if ``time_col`` is not among ``keys`` the newest one counts.
    """
    settings_keys = list(settings_keys)
    cell = F.struct("setting", "unit")
    own = {n: (F.col("name") == n) & F.col("setting").isNotNull() for n in names}
    timed = time_col in settings.columns
    if not (timed and time_col in keys):
        newest = F.col(time_col) if timed else F.lit(0)
        picked = [F.max_by(cell, F.when(is_own, F.struct(newest, cell))).alias(n) for n, is_own in own.items()]
        return Settings(settings.groupBy(*settings_keys).agg(*picked, F.lit(True).alias("_known")), settings_keys, time_col, False)
    picked = [F.max(F.when(is_own, cell)).alias(n) for n, is_own in own.items()]
    history = settings.filter(F.col(time_col).isNotNull()).groupBy(*settings_keys, F.col(time_col).alias("_from")).agg(*picked)
    values = F.struct(*[F.col(n) for n in names])

    def changes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """The first row of each group, and those whose values, gaps filled from before, differ from the row before."""
        order = Window.partitionBy(*by).orderBy("_from")
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        filled = rows.withColumns({n: F.last(n, ignorenulls=True).over(so_far) for n in names})
        seen = filled.withColumns({"_values": values, "_number": F.row_number().over(order)}).withColumn("_before", F.lag("_values").over(order))
        return seen.filter((F.col("_number") == 1) | ~F.col("_values").eqNullSafe(F.col("_before"))).drop("_values", "_number", "_before")

    # Gaps are filled within the day only where the day has a value, so filling again over all days completes them.
    daily = changes(history.withColumn("_day", F.date_trunc("day", F.col("_from").cast("timestamp"))), [*settings_keys, "_day"]).drop("_day")
    following = F.lead("_from").over(Window.partitionBy(*settings_keys).orderBy("_from"))
    intervals = changes(daily, settings_keys).withColumn("_to", following)
    return Settings(intervals.withColumn("_known", F.lit(True)), settings_keys, time_col, True)


def with_settings(
    df: DataFrame,
    settings: DataFrame,
    names: Sequence[str],
    keys: Sequence[str] = KEYS,
    settings_keys: Sequence[str] = ("cluster_id",),
    time_col: str = "snapshot_ts",
) -> DataFrame:
    """``df`` with one text column per setting name: the value in force at the row's moment, and ``_known``.

    Settings with ``time_col`` are a history, and the newest value at or before the row's own ``time_col`` counts; settings without
    it hold at all times. If ``time_col`` is not among ``keys``, the newest value counts. All rows stay; a setting not known (yet)
    is NULL, and ``_known`` is false where no setting is.
    """
    found = settings_in_force(settings, names, keys, settings_keys, time_col).attach(df)
    return found.withColumns({n: F.col(n)["setting"] for n in names} | {"_known": F.coalesce("_known", F.lit(False))})


def setting_rows(found: Settings, names: Sequence[str], carried: Sequence[Column | str] = ()) -> DataFrame:
    """The settings of each row of ``found`` in long form (``name``, ``setting``, ``unit``); one without any keeps a row without a name.

    ``carried`` columns come along.
    """
    cells = [
        F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("name"), F.col(n)["setting"].alias("setting"), F.col(n)["unit"].alias("unit")))
        for n in names
    ]
    return found.frame.select(*found.own_keys(), *carried, F.inline_outer(F.filter(F.array(*cells), lambda c: c.isNotNull())))


def first_names(df: DataFrame, name: str, order: Sequence[Column], keys: Sequence[str] = KEYS, n: int = 5) -> DataFrame:
    """Per key: how many rows, and the first ``n`` names as text.

    The names are cut to ``n`` before they are collected, so no group is ever gathered whole.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        head = df.select(*keys, F.col(name).alias("_name"), rank.alias("_rank")).filter(F.col("_rank") <= n)
    else:
        # Global form: the limit leaves at most n rows for the window to number.
        cut = df.orderBy(*order).limit(n)
        head = cut.select(F.col(name).alias("_name"), F.row_number().over(Window.orderBy(*order)).alias("_rank"))
    pairs = F.array_sort(F.collect_list(F.struct("_rank", "_name")))
    names = head.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["_name"]), ", ").alias("names"))
    return keyed_join(counts, names, keys)


def spine(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Every key that occurs in any of the frames, once."""
    parts = [f.select(*keys).distinct() for f in frames]
    return functools.reduce(lambda a, b: a.unionByName(b), parts).distinct()


def interval_deltas(
    df: DataFrame,
    id_cols: Sequence[str],
    counters: Sequence[str],
    time_col: str = "snapshot_ts",
    cluster_keys: Sequence[str] = ("cluster_id",),
    bucket: str = "day",
    keep_first: bool = False,
) -> DataFrame:
    """Counter growth since the previous snapshot of the same series.

    A series may hold a large share of all rows, so it is never one window partition: the lag runs
    per (series, time bucket), and a copy of the last row of each bucket is handed to the series'
    next bucket, where it precedes the first row. Only those copies are ordered per series. A
    counter that fell was reset: its new value counts.
    """
    series = [*cluster_keys, *id_cols]
    now = F.struct(F.col(time_col).alias("t"), *[F.col(c) for c in counters])
    rows = df.withColumn("_bucket", F.date_trunc(bucket, F.col(time_col).cast("timestamp"))).withColumn("_now", now)
    last = rows.groupBy(*series, "_bucket").agg(F.max("_now").alias("_now"))
    following = F.lead("_bucket").over(Window.partitionBy(*series).orderBy("_bucket"))
    handed_on = last.withColumn("_bucket", following).filter(F.col("_bucket").isNotNull())
    both = rows.withColumn("_copy", F.lit(False)).unionByName(
        handed_on.withColumn("_copy", F.lit(True)), allowMissingColumns=True
    )
    in_bucket = Window.partitionBy(*series, "_bucket").orderBy("_now.t")
    out = both.withColumn("_before", F.lag("_now").over(in_bucket)).filter(~F.col("_copy"))
    if not keep_first:
        out = out.filter(F.col("_before").isNotNull())
    growth = {}
    for c in counters:
        before = F.col("_before").getField(c)
        step = F.col(c) - before
        growth[c] = F.when(before.isNull(), F.col(c)).when(step < 0, F.col(c)).otherwise(step)
    out = out.withColumn("interval_start", F.col("_before").getField("t"))
    return out.withColumns(growth).drop("_bucket", "_now", "_copy", "_before")


def counter_operator(id_cols: Sequence[str], counters: Sequence[str]) -> Callable:
    """Give an operator over cumulative counters the ``mode`` keyword.

    ``cumulative`` reads the counters as they are (since the last reset); ``interval`` first turns them into growth since the previous
    snapshot of the same series. A series is told by ``id_cols`` and the operator's ``keys`` but for ``time_col``, so any keys do;
    every series has resets of its own.
    """

    def wrap(op: Callable) -> Callable:
        signature = inspect.signature(op)

        @functools.wraps(op)
        def run(df: DataFrame, *args, mode: str = "cumulative", time_col: str = "snapshot_ts", **kwargs):
            if mode == "interval":
                if time_col not in df.columns:
                    raise ValueError(f"growth since the previous snapshot needs the column {time_col}")
                call = signature.bind(df, *args, **kwargs)
                call.apply_defaults()
                series = [k for k in call.arguments["keys"] if k != time_col]
                present = [c for c in counters if c in df.columns]
                ids = [c for c in id_cols if c in df.columns and c not in series]
                df = interval_deltas(df, ids, present, time_col, series)
            elif mode != "cumulative":
                raise ValueError(f"unknown mode {mode!r}")
            return op(df, *args, **kwargs)

        return run

    return wrap
