import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rasterloom.session import local_session, ship

    session = local_session("tests", cores=4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship(session)
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
