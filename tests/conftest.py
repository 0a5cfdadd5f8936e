import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelflow.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = {
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
        "spark.sql.warehouse.dir": f"file://{tmp_path_factory.mktemp('warehouse')}",
    }
    session = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "4"} | shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def frame(spark):
    """frame("a string, b int", (..), (..)): rows with a ``row_order`` column appended."""

    def make(schema, *rows):
        return spark.createDataFrame(
            [(*r, i) for i, r in enumerate(rows)], schema + ", row_order long"
        )

    return make
