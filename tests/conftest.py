from __future__ import annotations

import pytest

from fleetgauge.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "fleetgauge-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Build a DataFrame from literal rows with a DDL schema."""

    def build(schema: str, *values):
        return spark.createDataFrame([tuple(v) for v in values], schema)

    return build


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate one expression over literal inputs."""

    def run(schema: str, inputs, expression):
        data = [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(data, f"_i int, {schema}")
        return [r[0] for r in df.orderBy("_i").select(expression).collect()]

    return run
