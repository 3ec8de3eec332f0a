"""Registration of queries and the SQL fragments their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.sources.derive import Telemetry, with_derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The text of each check and the tables it reads, for checks that build on another.
CHECKS: dict[str, tuple[list[str], str]] = {}

K = "cluster_id, snapshot_ts"


def query(name: str, tables: list[str], sql: str | None) -> Callable:
    """Register ``build(telemetry) -> DataFrame`` under ``name``, with the SQL that must agree."""

    def add(build: Callable[[Telemetry], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Telemetry(spark, sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_derived(tables, sql)
            CHECKS[name] = tables, sql
        return build

    return add


# --- SQL fragments ------------------------------------------------------------------------------


def pct(n: str, d: str, digits: int = 2) -> str:
    """Percentage rounded half away from zero, NULL unless the denominator is positive."""
    f = 10**digits
    return (
        f"(CASE WHEN ({d}) > 0 THEN CAST(({200 * f} * CAST(({n}) AS HUGEINT) + ({d})) // (2 * CAST(({d}) AS HUGEINT)) AS DOUBLE) / {f} END)"
    )


def hit(h: str, r: str) -> str:
    return f"coalesce({pct(h, f'{h} + {r}')}, CAST(100 AS DOUBLE))"


def pct0(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) > 0 THEN {pct(n, d)} ELSE CAST(0 AS DOUBLE) END)"


def trunc(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) > 0 THEN CAST((10000 * CAST(({n}) AS HUGEINT)) // ({d}) AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END)"


def pretty(b: str) -> str:
    """Database-style size text."""
    out = f"CASE WHEN {b} < 10240 THEN {b} || ' bytes'"
    for step, unit in enumerate(("kB", "MB", "GB", "TB")):
        half = f"({b}) // {2 ** (9 + 10 * step)}"
        out += f" WHEN {half} < 20479 THEN (({half}) + 1) // 2 || ' {unit}'"
    return f"{out} WHEN {b} IS NOT NULL THEN ((({b}) // {2**49}) + 1) // 2 || ' PB' END"


def sized(b: str, digits: int = 2) -> str:
    """Size text with fixed decimals."""
    out = "CASE"
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        out += f" WHEN {b} < {1024 ** (power + 1)} THEN printf('%.{digits}f {unit}', {b} / {1024**power}::DOUBLE)"
    return f"{out} ELSE printf('%.{digits}f PB', {b} / {1024**5}::DOUBLE) END"


def age(now: str, then: str) -> str:
    return f"CAST(round((epoch_us({now}) - epoch_us({then})) / 1e6) AS BIGINT)"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST({x} AS DOUBLE))"


def rnd(x: str, digits: int) -> str:
    """The double rounded as it is held, ties to even."""
    return f"CAST({fixed(x, digits)} AS DOUBLE)"


def lsn(x: str) -> str:
    return (
        f"(('0x' || split_part({x}, '/', 1))::BIGINT * 4294967296 + ('0x' || split_part({x}, '/', 2))::BIGINT)"
    )


def top(n: int, order: str, keys: str = K) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) <= {n}"


def rule(source: str, name: str, severity: str, subject: str, metric: str, message: str, tail: str, keys: str = K) -> str:
    """One branch of a findings check."""
    return (
        f"SELECT {keys}, '{source}' AS source, '{name}' AS rule, '{severity}' AS severity, CAST({subject} AS VARCHAR) AS subject, "
        f"CAST({metric} AS DOUBLE) AS metric, {message} AS message {tail}"
    )


def setting(name: str, kind: str = "VARCHAR") -> str:
    """A setting of the row's cluster as of the row's moment, as a scalar subquery over rows aliased ``r``."""
    return (
        "CAST((SELECT arg_max(s.setting, s.snapshot_ts) FROM t_settings s WHERE s.cluster_id = r.cluster_id "
        f"AND s.snapshot_ts <= r.snapshot_ts AND s.name = '{name}') AS {kind})"
    )


CLIENT = "backend_type = 'client backend'"
SYSTEM = "('pg_catalog', 'information_schema', 'pg_toast')"
