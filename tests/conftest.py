import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from quantiva.session import get_spark  # noqa: E402

SF = "/root/testdata/sf0.001"

# FX1 employees (FIXTURES.md)
EMPLOYEES = [
    ("n01", 25, 52000, "Engineering", 1), ("n02", 28, 58000, "Engineering", 3),
    ("n03", 31, 60000, "Engineering", 5), ("n04", 34, 65000, "Engineering", 8),
    ("n05", 38, 70000, "Engineering", 12), ("n06", 41, 55000, "Marketing", 15),
    ("n07", 45, 61000, "Marketing", 3), ("n08", 29, 63000, "Marketing", 2),
    ("n09", 36, 54000, "Sales", 10), ("n10", 33, 56000, "Sales", 5),
]


@pytest.fixture(scope="session")
def spark():
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def employees(spark):
    return spark.createDataFrame(EMPLOYEES, "name string, age bigint, salary bigint, department string, years_experience bigint")
