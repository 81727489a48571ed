import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ebbtide.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "8g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def customers(spark, sf_dir):
    from ebbtide.plans.catalog import customer_table

    return customer_table(spark, sf_dir)


@pytest.fixture(scope="session")
def ready(spark, sf_dir):
    from ebbtide.plans.catalog import prepared

    return prepared(spark, sf_dir)
