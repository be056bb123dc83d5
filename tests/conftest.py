import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docloom.session import build_session  # noqa: E402

DATA = os.environ.get("DOCLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "docloom-tests", spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a Column function on one Python value."""
    from pyspark.sql import functions as F

    def run(fn, x, kind="string"):
        row = spark.createDataFrame([(x,)], f"x {kind}").select(fn(F.col("x")).alias("r")).first()
        return plain(row.r)

    return run


def plain(x):
    """Rows to tuples, deeply."""
    if isinstance(x, tuple):
        return tuple(plain(v) for v in x)
    if isinstance(x, list):
        return [plain(v) for v in x]
    return x
