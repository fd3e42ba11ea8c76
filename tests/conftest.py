import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from citemill.session import session

    s = session(
        "local[4]", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="citemill-test-"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="citemill-wh-")},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
