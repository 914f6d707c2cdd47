import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))      # data_paths


@pytest.fixture(scope="session")
def spark():
    from eddy.config import build_session
    s = build_session("local[*]", shuffle_partitions=8, app="eddy-tests")
    yield s
