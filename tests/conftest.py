import os
import sys

import pytest
from data_paths import ROOT, SF_SMALL

sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from postlens.session import local_session

    s = local_session("*", 8, app="postlens-tests")
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from oracle_check import duck

    return duck(SF_SMALL)
