import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from faultlens.session import local_session

    session = local_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
