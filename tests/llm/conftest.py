import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brute import DOCS, awkward_rows  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
