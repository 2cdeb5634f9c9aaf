import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabwright.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tabwright-tests")
    yield session
    session.stop()


@pytest.fixture
def rows():
    def collect(df):
        return sorted([tuple(r) for r in df.collect()], key=repr)

    return collect
