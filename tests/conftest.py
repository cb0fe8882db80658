import pytest

from cutlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "cutlens-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
