import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from corpus_kb.session import build_session  # noqa: E402

# started on import: test modules build Column expressions when they are collected
_session = build_session(
    "tests", "local[8]",
    **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
)
_session.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield _session
    _session.stop()


@pytest.fixture
def evaluate(spark):
    """Value of one Column expression over given inputs, as columns of a one-row table."""

    def run(expression, **inputs):
        df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs))
        return df.select(expression.alias("out")).first()["out"]

    return run
