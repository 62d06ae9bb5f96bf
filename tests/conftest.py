import pytest

from tests.oracle import connect, session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.fixture(scope="session")
def sf():
    return SF
