import os

import pytest

from vellum.session import build_session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PYTHONDONTWRITEBYTECODE", "1")
    s = build_session(cpus=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    return s
