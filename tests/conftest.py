import pytest

from lexisift.session import importable, local


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local(4, 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    importable(session)
    yield session
    session.stop()
