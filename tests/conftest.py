import pytest

from prepweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores="4", partitions=4, memory="6g")
