import sys
from pathlib import Path

import pytest

for folder in Path(__file__).resolve().parents[:2]:
    sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from jobsieve.session import local_session

    session = local_session("tests", cores="4", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
