import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]


@pytest.fixture(scope="session")
def spark():
    from hirelake.session import local_session

    session = local_session("*", shuffle_partitions=4, app="tests", memory="6g")
    yield session
    session.stop()
