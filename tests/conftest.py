import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from demandlake.session import get_session
    s = get_session("local[4]", 8, app_name="demandlake-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dl-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()
