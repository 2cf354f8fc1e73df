import os

import pytest

from markfuse.session import local_session

DATA = os.environ.get("MARKFUSE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores=4, spark__sql__shuffle__partitions="4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no driver tables here")
    return path
