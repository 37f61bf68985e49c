import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tendrel.session import local_session

    session = local_session("4", "tests", 4, spark__sql__execution__arrow__maxRecordsPerBatch="1000")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
