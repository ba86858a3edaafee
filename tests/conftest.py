import pytest

from scanloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "scanloom-tests")
    yield session
    session.stop()
