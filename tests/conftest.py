import pytest

from cutlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "cutlake-tests")
    yield session
    session.stop()
