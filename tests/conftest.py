import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path(os.environ.get("MILLRACE_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("MILLRACE_DRIVER_MEMORY", "4g")
    from millrace.session import session

    s = session("tests", cpus=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    folder = DATA / "sf0.01"
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder)
