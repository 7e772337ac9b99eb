from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from evalspark.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="evalspark-test-ckpt-")
    s = get_spark("local[4]", app="evalspark-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g",
                         "spark.local.dir": tempfile.mkdtemp(prefix="evalspark-test-local-")})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="evalspark-test-")
