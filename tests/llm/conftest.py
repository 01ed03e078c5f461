import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cases import DOCS, awkward_documents  # noqa: E402


@pytest.fixture(scope="session")
def awkward():
    return awkward_documents()


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
