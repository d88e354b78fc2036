import pytest

from vellum.session import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")
