"""Queries that load in several steps derive their inputs once."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from starloom.plans import states
from starloom.sources import part_index
from starloom.sources.fixtures import Fixture


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    segment = "element_at(array('BUILDING', 'MACHINERY', 'FURNITURE'), cast(id % 3 + 1 as int))"
    made = {
        "nation": spark.range(25).selectExpr("cast(id as int) n_nationkey", "concat('NATION', id) n_name"),
        "customer": spark.range(40).selectExpr("id c_custkey", "concat('Customer', id) c_name", f"{segment} c_mktsegment", "cast(id % 25 as int) c_nationkey",
                                               "cast(id - 10 as double) c_acctbal"),
        "supplier": spark.range(7).selectExpr("id s_suppkey", "concat('Supplier', id) s_name", "cast(id % 25 as int) s_nationkey"),
        "orders": spark.range(300).selectExpr("id o_orderkey", "id * 7 % 40 o_custkey", "cast(date_add(date'1995-03-01', cast(id * 13 % 1500 as int)) as timestamp) o_orderdate",
                                              "cast(id * 31.5 as double) o_totalprice", "concat(id % 5 + 1, '-X') o_orderpriority"),
        "lineitem": spark.range(900).selectExpr("id % 300 l_orderkey", "id % 7 l_suppkey", "cast(date_add(date'1995-03-05', cast(id * 13 % 1500 as int)) as timestamp) l_shipdate"),
    }
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name, views", [
    ("kpis_states", ["review", "history"]), ("row_count_audit", ["review", "stg_history", "stg_assignment", "stg_employee_dirty", "stg_project"]),
    ("apply_assignments_table", ["stg_assignment"])])
def test_a_view_is_derived_once(spark, tables, monkeypatch, name, views):
    seen = {}
    for view in views:
        own, n = getattr(Fixture, view), spark.sparkContext.accumulator(0)
        seen[view] = (own(Fixture(spark, tables)).count(), n)

        def counted(self, own=own, n=n):
            def count(it):
                for b in it:
                    n.add(b.num_rows)
                    yield b
            df = own(self)
            return df.mapInArrow(count, df.schema)
        monkeypatch.setattr(Fixture, view, counted)
    assert entry.queries()[name](spark, tables).collect()
    for view, (rows, n) in seen.items():
        assert 0 < n.value == rows, view


def test_states_of_changed_rows_follow_their_counts(spark):
    """Repeated rows and nulls count as often as they differ."""
    schema = "review_id long, review_year int, department_key long, review_score decimal(5,2), performance_rating int"
    a, b, c, d = [(1, 2000, 5, None, 3), (2, 2000, 5, None, None), (3, None, 6, None, 2), (4, 2001, None, None, 1)]
    old, new = spark.createDataFrame([a, a, a, b, c], schema), spark.createDataFrame([a, b, b, d, d], schema)
    got = states.changed_state(old, new)
    want = states.fact_state(old.exceptAll(new), -1).unionByName(states.fact_state(new.exceptAll(old)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert got.filter("reviews = -2").count() == 1 and got.filter("reviews = 2").count() == 1


def test_filters_are_the_same_however_many_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(part_index, "SMALL", 0)
    df = spark.range(400).selectExpr("id * 3 AS k", "if(id % 9 = 0, null, id % 11) AS v", "id % 5 AS u")
    built = []
    for held in (1, 32):
        monkeypatch.setattr(part_index, "HELD", held)
        built.append(part_index.build(df, F.col("u").cast("string"), [["k"], ["v", "k"]]))
    assert built[0] == built[1] and all(any(f) for x in built[0].values() for f in x["filters"].values())
