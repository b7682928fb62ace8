import pytest

from caseloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 8, partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
