"""Reading telemetry tables and writing reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.sources.schemas import SCHEMAS

PARTITION = "snapshot_date"
#: Second level of the folders: the collector job that wrote them.
RUN = "run"


def read_telemetry(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType | None = None,
    clusters: Sequence[str] | None = None,
    since: date | None = None,
    until: date | None = None,
    partitioned: bool = True,
    streaming: bool = False,
) -> DataFrame:
    """One telemetry table below ``root`` with its declared schema, nothing inferred.

    The table lies in ``root/table``, partitioned by ``snapshot_date`` and run: the date bounds prune
    partitions, the cluster list is pushed down to the file scan. ``since`` is inclusive, ``until``
    exclusive.
    """
    declared = schema or SCHEMAS[table]
    if partitioned:
        declared = T.StructType([*declared.fields, T.StructField(PARTITION, T.DateType()), T.StructField(RUN, T.StringType())])
    reader = spark.readStream if streaming else spark.read
    df = reader.schema(declared).parquet(f"{root.rstrip('/')}/{table}")
    if clusters is not None:
        df = df.filter(F.col("cluster_id").isin(*clusters))
    if since is not None:
        df = df.filter(F.col(PARTITION) >= F.lit(since))
    if until is not None:
        df = df.filter(F.col(PARTITION) < F.lit(until))
    return df.drop(PARTITION, RUN) if partitioned else df


def _write_days(df: DataFrame, path: str, run: str, folders: Sequence[str], order: Sequence[str]) -> None:
    """Replace what this run has written of the days (and other folders) that ``df`` holds, and nothing else.

    Rows of one folder are brought together; the rebalance hint lets Spark split one that outgrows the advisory partition size and
    merge small ones, so a folder is written by few tasks. A job that is repeated, or retried after a failure, leaves one copy.
    """
    day = df.withColumns({PARTITION: F.to_date("snapshot_ts"), RUN: F.lit(run)})
    together = day.hint("rebalance", *[F.col(c) for c in order])
    writer = together.sortWithinPartitions(*order, "snapshot_ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*folders).parquet(path)


def write_telemetry(df: DataFrame, root: str, table: str, run: str = "collector") -> None:
    """Add the snapshots of a collector run to a telemetry table, in folders by day and run.

    A run owns its rows of a day: writing them again replaces them. Jobs that collect at the same time carry names of their own in
    ``run``. Files are sorted by cluster for row-group skipping.
    """
    _write_days(df, f"{root.rstrip('/')}/{table}", run, [PARTITION, RUN], [PARTITION, "cluster_id"])


def write_report(df: DataFrame, path: str, format: str = "json", mode: str = "overwrite") -> None:
    """A report as JSON lines or Parquet."""
    if format not in ("json", "parquet"):
        raise ValueError(f"unknown report format {format!r}")
    # A NULL field is part of a JSON row.
    options = {"ignoreNullFields": "false"} if format == "json" else {}
    df.write.mode(mode).format(format).options(**options).save(path)


def as_json(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every row as one JSON text (NULL fields kept), beside its keys."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(*keys, row.alias("json"))


def write_baseline(metrics: DataFrame, path: str, run: str = "baseline") -> None:
    """A baseline metric table, one folder per day, section and run; a run that is repeated replaces its own.

    A day's section is written by the tasks that hold it, not by every task.
    """
    order = [PARTITION, "section", *[c for c in ("cluster_id",) if c in metrics.columns]]
    _write_days(metrics, path, run, [PARTITION, "section", RUN], order)


def read_baseline(
    spark: SparkSession, path: str, schema: T.StructType, sections: Sequence[str] | None = None, since: date | None = None, until: date | None = None
) -> DataFrame:
    """The metrics of a baseline table (``schema`` as written); sections and days prune folders."""
    files = [f for f in schema.fields if f.name != "section"]
    folders = [T.StructField(PARTITION, T.DateType()), T.StructField("section", T.StringType()), T.StructField(RUN, T.StringType())]
    df = spark.read.schema(T.StructType([*files, *folders])).parquet(path)
    if sections is not None:
        df = df.filter(F.col("section").isin(*sections))
    if since is not None:
        df = df.filter(F.col(PARTITION) >= F.lit(since))
    if until is not None:
        df = df.filter(F.col(PARTITION) < F.lit(until))
    return df.select(*schema.fieldNames())
