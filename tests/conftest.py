import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from conflictlake.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="cl-test-ckpt-")
    s = get_spark("local[4]", app="conflictlake-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
