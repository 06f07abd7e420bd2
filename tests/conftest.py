import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    from cadastra.session import local_session

    session = local_session(4, "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
