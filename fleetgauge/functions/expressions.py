"""Scalar expressions: Column in, Column out, all inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
BYTES_PER_GB = 1024 * 1024 * 1024
XID_LIMIT = 2147483647
SETTING_UNITS = {
    "B": 1,
    "kB": 1024,
    "8kB": 8 * 1024,
    "16kB": 16 * 1024,
    "32kB": 32 * 1024,
    "MB": 1024**2,
    "GB": 1024**3,
}
PRETTY_UNITS = ("kB", "MB", "GB", "TB", "PB")
REPORT_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
SYSTEM_QUERY_PATTERNS = ("%pg_stat_statements%", "%pg_catalog%", "%information_schema%", "%pg_toast%")

# Above this, 20000 * n no longer fits a BIGINT and the decimal path takes over.
_SAFE_LONG = 400_000_000_000_000


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def int_div(n: Column, d: Column) -> Column:
    """Integral division."""
    return F.call_function("div", n, d)


def round_half_up_div(n: Column, d: Column, scale: int) -> Column:
    """``round(scale * n / d)`` for non-negative integers, ties away from zero, no floating point.

    Counters normally fit the BIGINT path; the decimal path only runs for rows beyond it.
    """
    fits = (n < _SAFE_LONG) & (d < _SAFE_LONG)
    wide_n, wide_d = n.cast("decimal(20,0)"), d.cast("decimal(20,0)")
    small = int_div(n * F.lit(2 * scale) + d, d * F.lit(2))
    wide = int_div(wide_n * F.lit(2 * scale).cast("decimal(8,0)") + wide_d, wide_d * F.lit(2).cast("decimal(1,0)"))
    return F.when(fits, small).otherwise(wide)


def percent(n: Column | str, d: Column | str, digits: int = 2) -> Column:
    """``round(100 * n / d, digits)`` as DOUBLE; NULL when ``d`` is not positive."""
    n, d = _c(n).cast("long"), _c(d).cast("long")
    factor = 10**digits
    return F.when(d > 0, round_half_up_div(n, d, 100 * factor) / F.lit(float(factor)))


def hit_ratio(hits: Column | str, reads: Column | str) -> Column:
    """Cache hit percentage; no traffic (or unknown) counts as 100."""
    hits, reads = _c(hits), _c(reads)
    return F.coalesce(percent(hits, hits + reads), F.lit(100.0))


def pct_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Percentage of a denominator; 0 when the denominator is missing or not positive.

    A missing numerator stays NULL, as in SQL.
    """
    n, d = _c(numerator), _c(denominator)
    return F.when(d > 0, percent(n, d)).otherwise(F.lit(0.0))


def trunc_pct(numerator: Column | str, denominator: Column | str) -> Column:
    """Percentage truncated (not rounded) to two decimals; 0 when the denominator is 0."""
    n, d = _c(numerator).cast("long"), _c(denominator).cast("long")
    narrow = int_div(n * F.lit(10000), d)
    wide = int_div(n.cast("decimal(20,0)") * F.lit(10000).cast("decimal(5,0)"), d.cast("decimal(20,0)"))
    return F.when(d > 0, F.when(n < _SAFE_LONG, narrow).otherwise(wide) / F.lit(100.0)).otherwise(F.lit(0.0))


def zero_as_missing(ratio: Column, default: float, enabled: bool = True) -> Column:
    """A ratio of exactly 0 is read as "unknown" and replaced, unless switched off."""
    return F.coalesce(F.nullif(ratio, F.lit(0.0)) if enabled else ratio, F.lit(float(default)))


def gb_to_bytes(gb: float) -> int:
    return int(gb * BYTES_PER_GB)


def size_gb(size: Column | str) -> Column:
    """Bytes as gigabytes with two decimals, rounded half away from zero."""
    size = _c(size).cast("long")
    whole = F.shiftright(size, 30)
    rest = size - whole * F.lit(BYTES_PER_GB)
    return (whole * F.lit(100) + round_half_up_div(rest, F.lit(BYTES_PER_GB).cast("long"), 100)) / F.lit(100.0)


def size_pretty(size: Column | str) -> Column:
    """Database-style size text: bytes below 10 kB, then whole units, halves rounded up."""
    size = _c(size).cast("long")
    sign = F.when(size < 0, F.lit("-")).otherwise(F.lit(""))
    size = F.abs(size)
    out = F.when(size < 10 * 1024, F.concat(size.cast("string"), F.lit(" bytes")))
    for step, unit in enumerate(PRETTY_UNITS):
        half_units = F.shiftright(size, 9 + 10 * step)
        text = F.concat(F.shiftright(half_units + 1, 1).cast("string"), F.lit(f" {unit}"))
        last = step == len(PRETTY_UNITS) - 1
        out = out.otherwise(text) if last else out.when(half_units < 20 * 1024 - 1, text)
    return F.when(size.isNotNull(), F.concat(sign, out))


def _binary_size(size: Column, digits: int) -> Column:
    """Size text with a fixed number of decimals, ties to even, exact for any BIGINT.

    The unit is picked once, as a bit shift; the digits then come from shifts alone.
    """
    bits, unit = F.lit(10 * (len(REPORT_UNITS) - 1)), F.lit(REPORT_UNITS[-1])
    for power in reversed(range(len(REPORT_UNITS) - 1)):
        fits = size < F.lit(1 << (10 * (power + 1))).cast("long")
        bits = F.when(fits, F.lit(10 * power)).otherwise(bits)
        unit = F.when(fits, F.lit(REPORT_UNITS[power])).otherwise(unit)

    def down(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    def up(x: Column) -> Column:
        return F.call_function("shiftleft", x, bits)

    scale = 10**digits
    one = F.lit(1).cast("long")
    whole = down(size)
    scaled = (size - up(whole)) * scale
    frac = down(scaled)
    twice_rest = (scaled - up(frac)) * 2
    above = (twice_rest > up(one)) | ((twice_rest == up(one)) & (frac % 2 == 1))
    units = whole * scale + frac + F.when(above, 1).otherwise(0)
    # A decimal with that scale prints exactly the wanted digits.
    return F.concat((units.cast("decimal(20,0)") / F.lit(scale)).cast(f"decimal(22,{digits})").cast("string"), F.lit(" "), unit)


def format_bytes(size: Column | str) -> Column:
    """Two-decimal size text; a missing size is ``0 B``."""
    size = _c(size).cast("long")
    sign = F.when(size < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(size.isNull(), F.lit("0 B")).otherwise(F.concat(sign, _binary_size(F.abs(size), 2)))


def format_size(size: Column | str) -> Column:
    """One-decimal size text; a missing or zero size is ``0 B``."""
    size = _c(size).cast("long")
    sign = F.when(size < 0, F.lit("-")).otherwise(F.lit(""))
    empty = size.isNull() | (size == 0)
    return F.when(empty, F.lit("0 B")).otherwise(F.concat(sign, _binary_size(F.abs(size), 1)))


def format_duration(seconds: Column | str) -> Column:
    """``Ns``, ``Nm Ns`` or ``Nh Nm``; missing is ``0s``."""
    s = F.coalesce(_c(seconds).cast("long"), F.lit(0).cast("long"))

    def part(value: Column, suffix: str) -> Column:
        return F.concat(value.cast("string"), F.lit(suffix))

    minutes = F.concat(part(int_div(s, F.lit(60)), "m "), part(s % 60, "s"))
    hours = F.concat(part(int_div(s, F.lit(3600)), "h "), part(int_div(s % 3600, F.lit(60)), "m"))
    return F.when(s < 60, part(s, "s")).when(s < 3600, minutes).otherwise(hours)


def size_to_bytes(value: Column | str, unit: Column | str) -> Column:
    """A setting times its unit; text that is no integer gives 0, an unknown unit counts once."""
    multiplier = F.lit(1).cast("long")
    for name, factor in SETTING_UNITS.items():
        multiplier = F.when(_c(unit) == name, F.lit(factor).cast("long")).otherwise(multiplier)
    return F.coalesce(_c(value).try_cast("long"), F.lit(0).cast("long")) * multiplier


def lsn_bytes(position: Column | str) -> Column:
    """Log position text ``hi/lo`` (hexadecimal) as an absolute byte position."""
    parts = F.split(_c(position), "/")
    high = F.conv(F.element_at(parts, 1), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.element_at(parts, 2), 16, 10).cast("decimal(20,0)")
    return (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(30,0)")


def lsn_diff(later: Column | str, earlier: Column | str) -> Column:
    return (lsn_bytes(later) - lsn_bytes(earlier)).cast("long")


def age_micros(now: Column | str, then: Column | str) -> Column:
    return F.unix_micros(_c(now).cast("timestamp")) - F.unix_micros(_c(then).cast("timestamp"))


def age_seconds(now: Column | str, then: Column | str) -> Column:
    """Elapsed whole seconds, rounded half away from zero."""
    return F.round(age_micros(now, then) / F.lit(1_000_000.0)).cast("long")


def older_than(now: Column | str, then: Column | str, seconds: int) -> Column:
    """True when ``then`` lies strictly more than ``seconds`` before ``now``."""
    return age_micros(now, then) > F.lit(int(seconds) * 1_000_000).cast("long")


def left_text(text: Column | str, length: int = 500) -> Column:
    return F.substring(_c(text), 1, length)


def regex_capture(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The captured group, NULL when the pattern does not match."""
    text = _c(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def exclude_like(text: Column | str, patterns: Sequence[str] = SYSTEM_QUERY_PATTERNS) -> Column:
    """True when the text matches none of the patterns; NULL text stays NULL (and is filtered out)."""
    text = _c(text)
    keep = F.lit(True)
    for pattern in patterns:
        keep = keep & ~text.like(pattern)
    return keep


def is_select(text: Column | str) -> Column:
    return _c(text).rlike(r"(?i)^\s*SELECT")


def not_system_schema(schema: Column | str) -> Column:
    return ~_c(schema).isin(*SYSTEM_SCHEMAS)


def prefix_of(longer: Column | str, shorter: Column | str) -> Column:
    """True when the first elements of ``longer`` are exactly ``shorter``."""
    return F.slice(_c(longer), F.lit(1), F.size(_c(shorter))) == _c(shorter)


def freshness_band(last: Column | str, now: Column | str) -> Column:
    """``never``, ``stale`` (over 7 days), ``recent`` (over 1 day) or ``fresh``."""
    last = _c(last)
    return (
        F.when(last.isNull(), "never")
        .when(older_than(now, last, 7 * 86400), "stale")
        .when(older_than(now, last, 86400), "recent")
        .otherwise("fresh")
    )


def band(value: Column | str, ladder: Sequence[tuple[str, float, object]], default: object) -> Column:
    """Threshold ladder ``[(operator, bound, result), ...]``; the first rung that holds wins."""
    value = _c(value)
    tests = {">": value.__gt__, ">=": value.__ge__, "<": value.__lt__, "<=": value.__le__}
    out = None
    for op, bound, result in ladder:
        hit = tests[op](bound)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def round_exact(value: Column, digits: int) -> Column:
    """Rounding of the number a DOUBLE really holds, ties to even.

    ``round`` and ``bround`` look at the shortest decimal text of the double instead, where 2.675
    (really a little less) is a tie. Here the product with the scale is taken together with its
    rounding error (the double is split in two halves whose products are exact), and the error
    decides where the product alone looks like a tie.
    """
    scale = float(10**digits)
    product = value * scale
    carrier = value * 134217729.0
    high = carrier - (carrier - value)
    error = (high * scale - product) + (value - high) * scale
    floor = F.floor(product).cast("double")
    looks_tied = (product - floor) == 0.5
    whole = F.when(looks_tied & (error > 0), floor + 1).when(looks_tied & (error < 0), floor).otherwise(F.rint(product))
    return whole / scale


def fixed_text(value: Column, digits: int) -> Column:
    """Number text with fixed decimals (ties to even), for messages."""
    return F.format_string(f"%.{digits}f", round_exact(value.cast("double"), digits))
