import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from essenta.session import SPLIT_ROWS_CONF, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "essenta-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "split"])
def split(request, spark):
    """Run once with whole groups and once with every group above 40 rows cut into ranges."""
    spark.conf.set(SPLIT_ROWS_CONF, "40" if request.param == "split" else "1000000")
    yield request.param
    spark.conf.unset(SPLIT_ROWS_CONF)
