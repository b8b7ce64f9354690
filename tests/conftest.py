import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gleanmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # Without spark.checkpoint.dir in the defaults, the warehouse holds what is written in between.
    session = build_session(
        "tests", "local[*]", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def outcomes(spark):
    """Evaluate a column function on single values: ``outcomes(fn, [a, b])`` gives the list of results."""
    from pyspark.sql import functions as F

    def run(function, values, dtype="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {dtype}")
        return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]

    return run


def rows(df, *columns):
    """Sorted tuples of some columns; nulls sort first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, v) for v in r))


@pytest.fixture
def table():
    return rows
