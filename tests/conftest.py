import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from croupier.session import local_session

    s = local_session(4, 4, app="croupier-tests")
    yield s


@pytest.fixture(scope="session")
def wh(spark):
    from croupier.plans.warehouse import Warehouse

    return Warehouse.from_driver_tables(spark, SMALL)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con
