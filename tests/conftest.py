import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def _build_warehouse_once(spark):
    """The fixture warehouse is the same for every test: built and written
    once a session and scale, wherever a module looks the function up."""
    from starloom.session import materialize
    from starloom.sources import fixtures
    build, kept = fixtures.fixture_warehouse, {}

    def once(s, sf_dir):
        if sf_dir not in kept:
            dw = build(s, sf_dir)
            kept[sf_dir] = dw.with_(**{t: materialize(getattr(dw, t)) for t in ("dim_date", "dim_department", "dim_project", "dim_employee", "fact")})
        return kept[sf_dir]
    import __spark_entry__  # noqa: F401  (loads the modules that use it)
    for m in list(sys.modules.values()):
        if getattr(m, "fixture_warehouse", None) is build:
            m.fixture_warehouse = once


@pytest.fixture(scope="session")
def spark():
    from starloom.session import local_session
    s = local_session("*", 8, app="starloom-tests")
    _build_warehouse_once(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from starloom.sources.testdata import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
