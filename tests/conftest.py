import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("4")
    yield made
    made.stop()


@pytest.fixture
def folder(spark, tmp_path):
    return str(tmp_path)
