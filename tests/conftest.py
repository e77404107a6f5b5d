import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from churnlens.session import build_session
    scratch = tempfile.mkdtemp(prefix="churnlens-test-")
    s = build_session("local[4]", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
        "spark.local.dir": os.path.join(scratch, "local"),
        "spark.driver.memory": "4g",
    })
    yield s
    s.stop()
