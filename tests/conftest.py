import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tardygrade.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, memory="4g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def done(spark, sf):
    """Completed, cleaned trips of the smallest tables, stored."""
    from tardygrade.operators import silver
    from tardygrade.session import materialize
    from tardygrade.sources import trips

    return materialize(silver.completed(silver.silver(trips(spark, sf))), "done")
