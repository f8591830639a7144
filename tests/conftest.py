"""One local session for all tests."""

from __future__ import annotations

import pytest

from quillon.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="3g", name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
