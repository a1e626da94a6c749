import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scorelake.session import local_session

    session = local_session(4, 4, spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    session.stop()
