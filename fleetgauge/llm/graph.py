"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import shared_dir


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Re-link neighbours to the smallest one: the larger neighbours of every node, or (``larger=False``) the smaller ones."""
    if larger:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = edges.join(least, "u")
    if larger:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) for every node with an edge, from columns ``u`` and ``v``.

    Each round replaces the edges by their stars in a table below ``folder`` (default: the session's shared folder); only a count and
    a checksum come to the driver. A node's edges are aggregated, never gathered.
    """
    spark = edges.sparkSession
    folder = folder or f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"

    def stored(df: DataFrame, n: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{n}")
        return spark.read.parquet(f"{folder}/{n}")

    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 0)
    before, n = None, 0
    while (mark := _mark(now)) != before:
        before, n = mark, n + 1
        now = stored(_stars(_stars(now, True), False), n)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
