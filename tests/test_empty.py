"""Every operator also runs over empty tables."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from test_catalogue import QUERIES

# training on nothing is an error, and an empty benchmark snapshot is refused
NEEDS_ROWS = ("k9_", "o1_", "o2_", "x2_")


@pytest.fixture(scope="module")
def empty_dir(sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        pq.write_table(pq.read_table(path).slice(0, 0), folder / os.path.basename(path))
    return str(folder)


# the first query of each inventory row
FIRST = {name.split("_")[0]: name for name in reversed(QUERIES) if not name.startswith(NEEDS_ROWS)}


@pytest.mark.parametrize("name", sorted(FIRST.values()))
def test_runs_on_nothing(spark, empty_dir, name):
    QUERIES[name](spark, empty_dir).collect()
