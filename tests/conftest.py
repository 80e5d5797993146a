import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from lattiq.session import session

    s = session(f"local[{os.environ.get('TEST_CPUS', '4')}]", shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.ansi.enabled", "true")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
