import os

import pytest

from plumbline.session import local_session, release_scratch

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    release_scratch(session)


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def t_profile(spark):
    rows = [("North", 100.0, 10), ("South", 120.0, 12), ("East", None, 11), ("North", 110.0, 9), ("South", 100000.0, 10), ("East", 105.0, 8)]
    return spark.createDataFrame(rows, "region string, revenue double, orders bigint")


@pytest.fixture(scope="session")
def t_sales(spark):
    """Twelve month ends as text, four regions, three products, one spike."""
    ends = ["01-31", "02-29", "03-31", "04-30", "05-31", "06-30", "07-31", "08-31", "09-30", "10-31", "11-30", "12-31"]
    revenue = [100, 110, 120, 130, 140, 150, 900, 160, 170, 180, 190, 200]
    rows = [
        (f"2024-{end}", ["North", "South", "East", "West"][i % 4], ["A", "B", "C"][i % 3], revenue[i], revenue[i] // 10)
        for i, end in enumerate(ends)
    ]
    return spark.createDataFrame(rows, "date string, region string, product string, revenue bigint, orders bigint")
