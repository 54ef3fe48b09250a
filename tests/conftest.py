import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledger_rows import make_ledger  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from ledgerscope.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def ledger(spark):
    return lambda rows, partitions=None: make_ledger(spark, rows, partitions)
