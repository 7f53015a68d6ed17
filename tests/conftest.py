import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postflow.session import local_session  # noqa: E402

# Started here, because test modules name columns while they are imported.
_SESSION = local_session(8, shuffle_partitions=4)
_SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield _SESSION
    _SESSION.stop()
