import pytest

from cadastra.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", memory="4g", partitions=4)
    yield session
    session.stop()
