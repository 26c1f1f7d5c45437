import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from eventloom.session import build_session
    s = build_session("local[8]", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def all_hot(monkeypatch):
    """Every case takes the route of the hot ones."""
    from eventloom.operators import sequence
    monkeypatch.setattr(sequence, "LARGE_ROWS", 1)
    monkeypatch.setattr(sequence, "PART_ROWS", 40)
