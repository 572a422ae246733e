import pytest

from snapscope.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = local_session(cpus=4, name="snapscope-tests", partitions=2, conf={"spark.sql.warehouse.dir": warehouse})
    yield session
    session.stop()
