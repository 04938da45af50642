"""One Spark session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ["TZ"] = "UTC"
    session = local_session(4, 4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
