import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from check import session

    return session()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return c
