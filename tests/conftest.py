import os

import pytest

from graphloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=int(os.environ.get("TEST_CPUS", "8")), memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    return folder
