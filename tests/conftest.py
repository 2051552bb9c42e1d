from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tallyroom.session import local_session, release_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    yield session
    release_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    from compare import database

    return database(sf_dir)
