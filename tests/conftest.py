import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagecensus.session import drop_materialised, ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    ensure_checkpoint_dir(session)
    yield session
    drop_materialised(session)
    session.stop()
