import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached():
    """What a module's tests have cached ends with it, so that others may ask whether anything is cached."""
    yield
    session = SparkSession.getActiveSession()
    if session is not None:
        session.catalog.clearCache()
