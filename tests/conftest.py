import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from threadlake.session import local_session

    s = local_session(4, "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
