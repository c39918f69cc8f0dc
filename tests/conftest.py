import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfprice import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return SMALL


@pytest.fixture
def one(spark):
    """Value of an expression over a one-row table."""
    def evaluate(column, **values):
        columns = ", ".join(f"{k} {_type(v)}" for k, v in values.items()) or "x int"
        row = tuple(values.values()) or (0,)
        return spark.createDataFrame([row], columns).select(column.alias("v")).first()["v"]

    def _type(value):
        return {str: "string", float: "double", int: "int"}[type(value)]

    return evaluate
