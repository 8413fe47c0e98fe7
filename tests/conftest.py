import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from stylomill.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DOCS = "id BIGINT, author STRING, genre STRING, text STRING"


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema=DOCS):
        return spark.createDataFrame(rows, schema)

    return make
