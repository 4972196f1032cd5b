from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tests.session import local_session  # noqa: E402
from trailspark.plans.catalog import event_table  # noqa: E402
from trailspark.session import ensure_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = ensure_session(local_session())
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """The event table at the smallest scale, times cut to minutes so that some tie."""
    return event_table(spark, SMALL)


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
