import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyglass.session import local_session

    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tallyglass.plans.base import Tables

    return Tables(spark, SMALL)


@pytest.fixture
def many_partitions(spark):
    """Keep small shuffles apart, so that one key really spans several tasks."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7",
             "spark.sql.execution.arrow.maxRecordsPerBatch": "20"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
