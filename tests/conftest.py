import pytest

from momentis.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
