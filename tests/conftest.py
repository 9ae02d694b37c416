import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hushframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "hushframe-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    # Small results stay in several tasks, as large ones do.
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return session


@pytest.fixture
def as_of():
    return "2026-01-01"
