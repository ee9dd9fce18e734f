import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tabularium.session import create_session

    session = create_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__sql__streaming__metricsEnabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Force the paths for large groups on tiny data."""
    spark.conf.set("spark.tabularium.maxGroupRows", "25")
    yield
    spark.conf.unset("spark.tabularium.maxGroupRows")


@pytest.fixture
def sf_dir():
    return SF_DIR
