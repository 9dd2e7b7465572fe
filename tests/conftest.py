import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

import support  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return support.session()


@pytest.fixture(scope="session")
def con():
    return support.oracle(support.SMALL)
