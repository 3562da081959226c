import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

os.environ.setdefault("TESSERA_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    s = build_session("local[4]", app="tessera-tests", shuffle_partitions=8)
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"
