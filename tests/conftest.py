import pytest

from quire.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", cores="8")
