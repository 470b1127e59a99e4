import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fedloom.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def nulls(spark):
    rows = [
        (1, 4, 1.0, "a", True), (2, None, 2.0, "b", False), (3, 2, None, None, True),
        (4, 5, float("nan"), "a", None), (5, 4, 7.0, "c", False),
    ]
    return spark.createDataFrame(rows, "id int, i int, x double, s string, b boolean")


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(1.0, 2, "u"), (3.0, None, None), (5.0, 6, "u")], "`a b` double, `x.y` int, `t` string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]
