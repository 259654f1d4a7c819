import pytest

from noctiluca.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__ui__showConsoleProgress="false", spark__default__parallelism="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
