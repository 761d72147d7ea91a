import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from garbline.session import clear_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores="8", partitions=4, memory="6g", shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    clear_scratch(session)
    session.stop()
