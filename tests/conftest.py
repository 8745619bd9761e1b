import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pumpwatch.session import get_session
    s = get_session("local[*]", shuffle_partitions=8,
                    shared=f"file://{tmp_path_factory.mktemp('shared')}")
    yield s
    s.stop()
