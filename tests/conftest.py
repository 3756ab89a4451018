import pytest

from fieldlake.session import configure, create_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = create_session(
        "fieldlake-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()
