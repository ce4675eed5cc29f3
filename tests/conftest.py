import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from korvine.session import build

    session = build(8, 8, "8g")
    yield session
    session.stop()
