"""Exact dedup over an extendible-hash index kept on shared files.

The directory over the leading bits of the texts' hash keys is built first, from the distinct keys alone. It doubles until no bucket
holds more than ``capacity`` keys; a bucket is split only as deep as it is overfull itself, so several directory cells may share one.
Every row finds its cell, and through it the bucket, which decides where its text is grouped, chained and looked up.

The index has one entry per distinct text: its bucket, hash key, place in the chain of texts with that key, the row that stays and the
number of copies. Texts are compared byte for byte, as grouping columns within the bucket; copies are counted before they are
shuffled, so a text that a third of all rows share sends one row per task. Entries are written by range of (bucket, key), so that one
task owns a bucket's chains. Rows then look up their entry by bucket, key and digest; where a chain holds two texts with one digest, by
the text itself. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.session import shared_dir

ROOT_BITS = 4
STEP_BITS = 4


@dataclass(frozen=True)
class Index:
    """``entries``: bucket, key, chain, digest, keep_id, group_size, twin; ``directory``: cell, bucket, depth."""

    entries: DataFrame
    directory: DataFrame
    depth: int

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with a ``key``, and the ``bucket`` that the directory sends them to.

        The directory has a few cells per ``capacity`` keys; Spark broadcasts it while it is small.
        """
        cells = self.directory.select("cell", "bucket")
        return rows.withColumn("cell", _cell(F.col("key"), self.depth)).join(cells, "cell").drop("cell")


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _cell(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def build_directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The directory for distinct ``key`` values, and its depth.

    Doubles, a few bits at a time, while a cell is overfull. Every cell's bucket is the shortest prefix of the cell that holds at most
    ``capacity`` keys.
    """
    depth = ROOT_BITS
    while True:
        cells = keys.groupBy(_cell(F.col("key"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        fullest = cells.agg(F.max("n")).first()[0] or 0
        if fullest <= capacity or depth + STEP_BITS > 60:
            break
        depth += STEP_BITS
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - level)"))
    held = levels.groupBy("level", "prefix").agg(F.sum("n").alias("held")).filter(F.col("held") <= capacity)
    fitting = levels.join(held, ["level", "prefix"]).groupBy("cell").agg(F.min("level").alias("fit"))
    directory = cells.join(fitting, "cell", "left").select("cell", F.coalesce("fit", F.lit(depth)).alias("depth"))
    # A bucket is named by its first cell.
    return directory.select("cell", "depth", F.expr(f"shiftleft(shiftrightunsigned(cell, {depth} - depth), {depth} - depth)").alias("bucket")), depth


def build_index(docs: DataFrame, folder: str, capacity: int, key: Callable[[Column], Column], digest: Callable[[Column], Column]) -> Index:
    """Index ``doc_id`` and ``text`` under ``folder``, which every executor has to reach."""
    keyed = docs.select("doc_id", "text", key(F.col("text")).alias("key"))
    cells, depth = build_directory(_stored(keyed.select("key").distinct(), folder, "keys"), capacity)
    index = Index(docs, _stored(cells, folder, "directory"), depth)
    texts = index.placed(keyed).groupBy("bucket", "key", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = texts.select("bucket", "key", digest(F.col("text")).alias("digest"), F.octet_length("text").alias("n_bytes"), "keep_id", "group_size")
    slot = Window.partitionBy("bucket", "key").orderBy("digest", "n_bytes", "keep_id")
    twins = F.count(F.lit(1)).over(Window.partitionBy("bucket", "key", "digest", "n_bytes")) > 1
    owned = _stored(found, folder, "found").repartitionByRange("bucket", "key")
    chained = owned.withColumns({"chain": F.row_number().over(slot), "twin": twins})
    return replace(index, entries=_stored(chained.sortWithinPartitions("bucket", "key", "chain"), folder, "entries"))


def exact_dedup(
    docs: DataFrame,
    capacity: int = 16384,
    folder: str | None = None,
    key: Callable[[Column], Column] = _key,
    digest: Callable[[Column], Column] = _digest,
) -> DataFrame:
    """For every row: the largest ``doc_id`` among rows of the same text, the number of such rows, and whether this is the one.

    One row per input row, dropped ones too: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``bucket``,
    ``chain``. Texts are equal when identical; a null text counts as empty. A row without ``doc_id`` counts in its group and stays only
    if no row of the group has an id, with a null ``keep_id``. Repeated rows of one id and text are all the kept row. Other columns
    are ignored. No documents give no rows.

    ``folder`` (default: below the session's shared folder) receives the index. ``key`` and ``digest`` may be weakened in tests.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/exact-dedup-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    index = build_index(rows, folder, capacity, key, digest)
    entries = index.entries.select("key", "digest", "n_bytes", "bucket", "chain", "keep_id", "group_size", "twin")
    text = F.col("text")
    probe = rows.select("doc_id", key(text).alias("key"), digest(text).alias("digest"), F.octet_length(text).alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))
    found = index.placed(probe).join(entries.filter("not twin").drop("twin"), ["bucket", "key", "digest", "n_bytes"])
    if not entries.filter("twin").isEmpty():
        found = found.unionByName(_by_text(index, rows, entries.filter("twin"), key, digest))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "bucket", "chain")


def _by_text(index: Index, rows: DataFrame, twins: DataFrame, key: Callable, digest: Callable) -> DataFrame:
    """Rows of texts that share key, digest and length with another text, matched by their text.

    The chain is numbered anew among the texts themselves; bucket and key are those of the index.
    """
    slots = twins.select("key", "digest", "n_bytes", "bucket").distinct()
    text = F.col("text")
    keyed = rows.select("doc_id", "text", key(text).alias("key"), digest(text).alias("digest"), F.octet_length(text).alias("n_bytes"))
    members = index.placed(keyed).join(slots, ["bucket", "key", "digest", "n_bytes"])
    groups = members.groupBy("key", "digest", "n_bytes", "bucket", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    slot = Window.partitionBy("key", "digest", "n_bytes").orderBy("text")
    groups = groups.withColumn("chain", F.row_number().over(slot)).drop("bucket")
    out = members.join(groups, ["key", "digest", "n_bytes", "text"])
    return out.withColumn("text_sha256", F.sha2(text, 256)).drop("text")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The input rows, all columns, less the copies; of repeated rows of one id and text one stays."""
    none = F.lit(-(1 << 63)).cast("long")
    marked = exact_dedup(docs, **options).filter("kept")
    keep = marked.select(F.coalesce("keep_id", none).alias("__id"), F.col("text_sha256").alias("__sha"))
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), none), "__sha": F.sha2(F.coalesce("text", F.lit("")), 256)})
    return own.join(keep, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"]).drop("__id", "__sha")
