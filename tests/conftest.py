import os
import sys
import time
from pathlib import Path

import pytest

os.environ["TZ"] = "UTC"  # naive datetimes of the tests are UTC
time.tzset()
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidewell.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield s
    s.stop()


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}"
