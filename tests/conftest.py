import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessella.session import build_session, release

    session = build_session(4, "tests", **{"spark.driver.memory": "4g"})
    yield session
    release(session)
    session.stop()


@pytest.fixture
def force_shuffle(monkeypatch):
    """Makes `attach` take its way for tables that are too large to broadcast."""
    from tessella.operators import lookup

    monkeypatch.setattr(lookup, "fits", lambda *a, **k: False)
