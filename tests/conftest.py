import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def tables(spark):
    from corpusmill.plans.registry import Tables

    return Tables(spark, "/root/testdata/sf0.001")
