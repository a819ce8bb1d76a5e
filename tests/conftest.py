import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[1]) + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from assayer.session import local_session

    return local_session("4", 4, "4g")


@pytest.fixture(scope="session")
def folder():
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test tables here")
    return path
