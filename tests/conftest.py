import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from courtline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate one Column on one row."""

    def run(column, **values):
        df = spark.range(1)
        for name, value in values.items():
            df = df.withColumn(name, value)
        return df.select(column.alias("v")).first()["v"]

    return run
