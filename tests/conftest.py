import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false pyspark-shell")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from terrane.session import build_session

    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
