"""Scalar expressions on literal values: boundaries, NULL and 0."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fleetgauge.functions import expressions as X


def test_hit_ratio(values):
    inputs = [(0, 0), (None, 5), (5, None), (1, 2), (2, 1), (0, 7), (7, 0), (1, 7)]
    got = values("h long, r long", inputs, X.hit_ratio("h", "r"))
    assert got == [100.0, 100.0, 100.0, 33.33, 66.67, 0.0, 100.0, 12.5]


def test_hit_ratio_beyond_bigint_products(values):
    big = 8_000_000_000_000_000_00
    assert values("h long, r long", [(big, big), (3 * 10**17, 10**17)], X.hit_ratio("h", "r")) == [50.0, 75.0]


def test_pct_ratio(values):
    inputs = [(5, 0), (5, None), (None, 5), (200, 100), (1, 3), (1, 800), (3, 800)]
    got = values("n long, d long", inputs, X.pct_ratio("n", "d"))
    # Halves round away from zero: 0.125 -> 0.13, 0.375 -> 0.38.
    assert got == [0.0, 0.0, None, 200.0, 33.33, 0.13, 0.38]


def test_trunc_pct(values):
    got = values("n long, d long", [(2, 3), (199999, 200000), (0, 5), (5, 0), (5, 5)], X.trunc_pct("n", "d"))
    assert got == [66.66, 99.99, 0.0, 0.0, 100.0]


def test_zero_as_missing(values):
    inputs = [0.0, None, 42.0]
    assert values("r double", inputs, X.zero_as_missing(F.col("r"), 100)) == [100.0, 100.0, 42.0]
    assert values("r double", inputs, X.zero_as_missing(F.col("r"), 100, False)) == [0.0, 100.0, 42.0]


def test_gb_to_bytes():
    assert X.gb_to_bytes(1) == 1073741824
    assert X.gb_to_bytes(0.5) == 536870912
    assert X.gb_to_bytes(0) == 0


def test_size_pretty(values):
    kb, mb = 1024, 1024**2
    inputs = [0, 10 * kb - 1, 10 * kb, 10 * kb + 511, 10 * kb + 512, 10485247, 10485248, 10 * mb, 10 * 1024**3, 10 * 1024**4, 2**60, None, -5, -20480]
    got = values("b long", inputs, X.size_pretty("b"))
    assert got == [
        "0 bytes", "10239 bytes", "10 kB", "10 kB", "11 kB", "10239 kB", "10 MB", "10 MB", "10 GB", "10 TB", "1024 PB", None, "-5 bytes", "-20 kB",
    ]


def _python_text(size: int, digits: int) -> str:
    power = min(5, max(0, (size.bit_length() - 1) // 10))
    return f"{Fraction(size, 1024**power):.{digits}f} " + ("B", "KB", "MB", "GB", "TB", "PB")[power]


def test_binary_size_text(values):
    rng = random.Random(7)
    inputs = [0, 1, 512, 1023, 1024, 1152, 1408, 1535, 1536, 1024**2 - 1, 1024**2, 1152 * 1024, 1408 * 1024**3, 2**53]
    inputs += [rng.randrange(0, 2 ** rng.randrange(1, 53)) for _ in range(400)]
    assert values("b long", inputs, X.format_bytes("b")) == [_python_text(b, 2) for b in inputs]
    assert values("b long", inputs, X.format_size("b")) == [_python_text(b, 1) if b else "0 B" for b in inputs]
    assert values("b long", [None, -1536], X.format_bytes("b")) == ["0 B", "-1.50 KB"]
    assert values("b long", [None, 0, -1536], X.format_size("b")) == ["0 B", "0 B", "-1.5 KB"]


def test_format_duration(values):
    inputs = [None, 0.0, 0.9, 59.9, 60.0, 61.0, 3599.0, 3600.0, 3661.0, 90000.0]
    got = values("s double", inputs, X.format_duration("s"))
    assert got == ["0s", "0s", "0s", "59s", "1m 0s", "1m 1s", "59m 59s", "1h 0m", "1h 1m", "25h 0m"]


def test_size_to_bytes(values):
    inputs = [("16", "8kB"), ("4", "MB"), ("2", "GB"), ("7", None), ("7", "B"), ("7", "min"), ("abc", "kB"), ("1.5", "kB"), (None, "kB"), ("3", "16kB"), ("3", "32kB")]
    got = values("v string, u string", inputs, X.size_to_bytes("v", "u"))
    assert got == [131072, 4194304, 2147483648, 7, 7, 7, 0, 0, 0, 49152, 98304]


def test_lsn(values):
    inputs = [("0/0", "0/0"), ("1/0", "0/FFFFFFFF"), ("16/B374D848", "16/B374D800"), ("A/10", "A/20"), (None, "0/1"), ("FFFFFFFF/FFFFFFFF", "FFFFFFFF/0")]
    got = values("a string, b string", inputs, X.lsn_diff("a", "b"))
    assert got == [0, 1, 72, -16, None, 4294967295]


def test_age_seconds_rounds(rows):
    df = rows(
        "a string, b string",
        ("2024-01-01 00:00:02.5", "2024-01-01 00:00:00"),
        ("2024-01-01 00:00:02.4", "2024-01-01 00:00:00"),
        ("2024-01-01 00:00:00", "2024-01-01 00:00:00.5"),
        ("2024-01-01 00:00:00", None),
    ).select(F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    assert [r[0] for r in df.select(X.age_seconds("a", "b")).collect()] == [3, 2, -1, None]


def test_text_filters(values):
    inputs = ["SELECT 1", "  select\n2", "UPDATE pg_catalog.x", None, "insert pg_toast"]
    assert values("q string", inputs, X.is_select("q")) == [True, True, False, None, False]
    assert values("q string", inputs, X.exclude_like("q")) == [True, True, False, None, False]
    assert values("q string", ["autovacuum: VACUUM a.b", "none", None], X.regex_capture("q", "autovacuum: (.*)")) == ["VACUUM a.b", None, None]
    assert values("q string", ["x" * 600, "ab", None], F.length(X.left_text("q"))) == [500, 2, None]


def test_system_schemas(values):
    inputs = ["public", "pg_catalog", "information_schema", "pg_toast", None]
    assert values("s string", inputs, X.not_system_schema("s")) == [True, False, False, False, None]


def test_prefix_of(values):
    inputs = [(["a", "b"], ["a"]), (["a"], ["a", "b"]), (["a", "b"], ["a", "b"]), (["b", "a"], ["a"])]
    assert values("x array<string>, y array<string>", inputs, X.prefix_of("x", "y")) == [True, False, True, False]


@pytest.mark.parametrize(
    ("last", "band"),
    [
        (None, "never"),
        ("2024-01-01 00:00:00", "recent"),
        ("2023-12-31 23:59:59", "stale"),
        ("2024-01-07 00:00:00", "fresh"),
        ("2024-01-06 23:59:59", "recent"),
    ],
)
def test_freshness_band(spark, last, band):
    df = spark.range(1).select(F.lit(last).cast("timestamp").alias("l"), F.lit("2024-01-08 00:00:00").cast("timestamp").alias("n"))
    assert df.select(X.freshness_band("l", "n")).first()[0] == band


def test_band_edges(values):
    ladder = [(">", 30, "critical"), (">", 10, "warning")]
    assert values("x double", [10.0, 10.01, 30.0, 30.01, None], X.band("x", ladder, "normal")) == ["normal", "warning", "warning", "critical", "normal"]


def test_round_exact_is_python_round(values):
    rng = random.Random(3)
    inputs = [0.5, 1.5, 2.5, -0.5, -2.5, 2.675, 1.005, 16.225, 18.275, 0.125, 0.375, 2.325, 72.525, 68.115]
    inputs += [rng.randrange(0, 10**6) / 1000 for _ in range(2000)] + [rng.randrange(1, 10**5) / rng.randrange(1, 999) for _ in range(2000)]
    for digits in (0, 1, 2):
        assert values("x double", inputs, X.round_exact(F.col("x"), digits)) == [round(x, digits) for x in inputs]
        assert values("x double", inputs[:500], X.fixed_text(F.col("x"), digits)) == [f"{round(x, digits):.{digits}f}" for x in inputs[:500]]
