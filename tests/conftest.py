import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ledgerlark.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "local[4]", 8, app_name="ledgerlark-tests",
        extra={"spark.driver.memory": "4g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    # tests own their checkpoint folder; on a cluster spark.checkpoint.dir is shared
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlark-test-ckpt-"))
    yield s
    s.stop()
