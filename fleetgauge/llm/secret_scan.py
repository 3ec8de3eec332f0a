"""Secret scan with multipart credential linking.

Three base patterns are reported wherever they match. Weak candidates (a name that may be a login, an unmarked random-looking string,
an address) mean little alone: an interval join of the parts of a document reports one only if parts of both other roles
(identifier, secret, endpoint; base matches play roles, too) start within ``scope`` characters of it. With ``pairs``, as in the
registered query, an identifier and a secret complement each other without an endpoint. The join meets, per role and bin
of ``scope`` characters, the first and last start, so its size is linear in the parts however dense they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import shared_dir

#: Kinds in the order of report, with the role each plays.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "id": "identifier", "key": "secret", "endpoint": "endpoint"}
BASE = 3

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
# Weak candidates.
_ID = re.compile(r"""(?<![a-z_])(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.ASCII | re.IGNORECASE)
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
_ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])""")
_MARKS = ("passw", "secret", "token", "api")

_SPAN = "struct<begin:long,kind:int,end:long>"
_ARROW_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Begin, kind and end of the base matches, in order."""
    low = text.lower()
    out = []
    if any(mark in low for mark in _MARKS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _random_looking(word: str) -> bool:
    return any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that do not overlap a base match."""
    found = [(m.start(), 3, m.end()) for m in _ID.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in _KEY.finditer(text) if _random_looking(m[0])]
    found += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    out, i = [], 0
    ends = []
    reach = 0
    for begin, _, end in base:
        reach = max(reach, end)
        ends.append((begin, reach))
    for begin, kind, end in sorted(found):
        while i < len(ends) and ends[i][0] < end:
            i += 1
        # The bases that begin before this one's end reach as far as the last of them.
        if i == 0 or ends[i - 1][1] <= begin:
            out.append((begin, kind, end))
    return out


def _matched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, weak = [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text)
                base.append([{"begin": b, "kind": k, "end": e} for b, k, e in found])
                weak.append([{"begin": b, "kind": k, "end": e} for b, k, e in weak_spans(text, found)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "id", "content")), pa.array(base, _ARROW_SPANS), pa.array(weak, _ARROW_SPANS)],
                names=["doc_id", "id", "content", "base", "weak"],
            )

    own = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    # A row is known by id and text; equal rows have equal parts.
    rows = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id long, id long, content long, base array<{_SPAN}>, weak array<{_SPAN}>")


def linked_spans(found: DataFrame, scope: int, pairs: bool = False) -> DataFrame:
    """The weak candidates (``id``, ``content``, ``begin``, ``kind``, ``end``) with parts of both other roles within the scope; with
    ``pairs``, identifiers with a secret and secrets with an identifier, too."""
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("part.kind") + 1)
    exploded = found.filter(F.size("weak") > 0).select("id", "content", F.explode(F.concat("base", "weak")).alias("part")).distinct()
    parts = exploded.select("id", "content", "part.*", role.alias("role"), F.expr(f"part.begin div {scope}").alias("bin"))
    bins = parts.groupBy("id", "content", "bin", "role").agg(F.min("begin").alias("first"), F.max("begin").alias("last"))
    roles = F.array(*[F.lit(r) for r in sorted(set(ROLES.values()))])
    asked = parts.filter(F.col("kind") >= BASE).withColumn("own", F.col("role")).drop("role")
    asked = asked.withColumn("role", F.explode(roles)).filter("role <> own")
    asked = asked.withColumn("bin", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)))
    met = asked.join(bins, ["id", "content", "bin", "role"]).filter((F.col("first") <= F.col("begin") + scope) & (F.col("last") >= F.col("begin") - scope))
    span = ("id", "content", "begin", "kind", "end")
    linked = met.groupBy(*span, "own").agg(F.countDistinct("role").alias("roles"), F.max(F.col("role") != "endpoint").alias("paired"))
    enough = (F.col("roles") == 2) | (F.lit(pairs) & F.col("paired") & (F.col("own") != "endpoint"))
    return linked.filter(enough).select(*span)


def scan_secrets(docs: DataFrame, scope: int = 200, pairs: bool = False) -> DataFrame:
    """Secrets of every whole text: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans``.

    ``base`` are the base matches and ``spans`` all reported ones, as arrays of (begin, kind number, end) in code points, end
    exclusive, by begin, then kind in the order of ``KINDS``. One row per input row. A null text counts as empty, with no spans. Rows
    without ``doc_id`` and repeated rows are scanned like any other; other columns are ignored.
    """
    spark = docs.sparkSession
    store = f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}"
    _matched(docs).write.parquet(store)
    found = spark.read.parquet(store)
    span = F.struct("begin", "kind", "end")
    linked = linked_spans(found, scope, pairs).groupBy("id", "content").agg(F.collect_list(span).alias("linked"))
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(f"array<{_SPAN}>"))))

    def number(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    return found.join(linked, ["id", "content"], "left").select("doc_id", *counts, F.array_sort("base").alias("base"), spans.alias("spans"))


def as_text(spans: str):
    """An array of spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")
