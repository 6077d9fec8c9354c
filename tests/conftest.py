import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowloom.plans.staging import drop_staged  # noqa: E402
from flowloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    yield session
    drop_staged(session)


@pytest.fixture
def small_tasks(spark):
    """Make every group too large for one task, so the chunked plans run."""
    spark.conf.set("flowloom.taskRows", "7")
    yield
    spark.conf.unset("flowloom.taskRows")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("flowloom.broadcastRows", "0")
    yield
    spark.conf.unset("flowloom.broadcastRows")
