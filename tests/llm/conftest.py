import pytest

from lexisift.llm.shared import importable


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)
