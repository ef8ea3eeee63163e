import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sentispark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[*]",
        "tests",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Value of a column expression over one row of given columns."""

    def evaluate(column, **columns):
        schema = ", ".join(f"{k} {t}" for k, (t, _) in columns.items()) or "x int"
        row = tuple(v for _, v in columns.values()) or (0,)
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    return evaluate
