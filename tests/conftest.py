import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from tracewell.session import session

    made = session("local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__driver__host="127.0.0.1")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
