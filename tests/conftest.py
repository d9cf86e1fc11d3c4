import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from panelwright.runtime import local_session
    folder = tmp_path_factory.mktemp("spark")
    session = local_session(8, 8, spark__sql__warehouse__dir=str(folder / "warehouse"),
                            spark__checkpoint__dir=str(folder / "checkpoints"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL
