import pytest

from lodestrata.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
