import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from vellum.session import local_session, ship

    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    ship(session)
    yield session
    session.stop()
