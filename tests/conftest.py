import pytest

from quern.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle=4, memory="4g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (dict, list)) else (True, "", str(x)) for x in r))
