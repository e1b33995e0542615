import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from millrace.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session(cpus=8, shuffle_partitions=8)
