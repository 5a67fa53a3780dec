import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tracelake.runtime import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """rows(data, schema) -> DataFrame"""
    return lambda data, schema: spark.createDataFrame(data, schema)


def got(df, *columns):
    """Sorted tuples of the columns, or of all."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
