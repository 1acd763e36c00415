import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from xcheck.session import build_session
    s = build_session("local[*]", 8, app="xcheck-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
