"""Staging scans, sinks and the versioned store."""
import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from starloom import schemas
from starloom.sources import staging as ST
from starloom.sources.fixtures import Fixture
from starloom.sources.store import Store


def _tmp():
    return tempfile.mkdtemp(prefix="starloom-test-")


def test_csv_round_trip_typed(spark):
    base = _tmp()
    f = Fixture(spark, SF_SMALL)
    src = f.review().select(*schemas.STAGING["stg_reviews"].fieldNames())
    ST.write_csv(src, os.path.join(base, "stg_reviews.csv"))
    back = ST.read_staging(spark, base, "stg_reviews")
    assert dict(back.dtypes)["review_date"] == "date" and dict(back.dtypes)["review_score"] == "decimal(5,2)"
    # a query touching only the corrupt-record column is not allowed on raw CSV
    assert back.filter(F.col("_corrupt").isNotNull()).select("review_id", "_corrupt").collect() == []
    assert back.drop("_corrupt").exceptAll(src.withColumn("review_id", F.col("review_id").cast("int"))
                                           .withColumn("employee_id", F.col("employee_id").cast("int"))
                                           .withColumn("project_id", F.col("project_id").cast("int"))).count() == 0


def test_malformed_csv_row_is_kept_as_corrupt(spark):
    base = _tmp()
    os.makedirs(base, exist_ok=True)
    with open(os.path.join(base, "stg_assignments.csv"), "w") as fh:
        fh.write("employee_id,project_id,role_on_project,allocation_pct,start_date,end_date\n")
        fh.write("1,2,Lead,50,2024-01-01,\n")
        fh.write("x,2,Lead,50,2024-01-01,\n")
    df = ST.read_staging(spark, base, "stg_assignments")
    rows = df.orderBy(F.col("_corrupt").asc_nulls_first()).collect()
    assert rows[0]["employee_id"] == 1 and rows[0]["start_date"] == dt.date(2024, 1, 1)
    assert rows[1]["_corrupt"] is not None


def test_missing_inputs_and_columns(spark):
    with pytest.raises(ST.MissingInput):
        ST.require_inputs(spark, _tmp())
    df = spark.createDataFrame([(1, 2)], "Age int, Attrition int")
    with pytest.raises(ValueError, match="Department"):
        ST.require_columns(df, schemas.REQUIRED_BASE_COLUMNS)


def test_store_publish_is_all_or_nothing(spark):
    s = Store(spark, os.path.join(_tmp(), "dw"))
    a = spark.range(5).withColumnRenamed("id", "k")
    v1 = s.publish({"a": a, "b": a})
    assert v1 == 1 and s.read("a").count() == 5
    s.append_table("a", spark.range(5, 7).withColumnRenamed("id", "k"))
    assert s.read("a").count() == 7 and s.read("b").count() == 5
    # a staged but uncommitted table is invisible to a new reader
    s.stage("b", spark.range(100).withColumnRenamed("id", "k"))
    fresh = Store(spark, s.base)
    assert fresh.read("b").count() == 5
    s.commit()
    assert Store(spark, s.base).read("b").count() == 100
    s.replace_table("a", spark.range(1).withColumnRenamed("id", "k"))
    assert Store(spark, s.base).read("a").count() == 1


def test_insert_ignore_and_params(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    out = ST.insert_ignore(t, b, ["k"], ["v"]).collect()
    assert [(r.k, r.v) for r in out] == [(2, "y")]
    r = ST.run_sql(spark, "SELECT count(*) n FROM {t} WHERE k >= :lo", {"lo": 2}, t=b).first()
    assert r.n == 2


def test_init_warehouse_recreates_empty_tables_with_seed(spark):
    from pyspark.sql import types as T
    from starloom.plans.dims import UNKNOWN_PROJECT
    s = Store(spark, os.path.join(_tmp(), "dw"))
    s.publish({"dim_project": spark.range(3).selectExpr("id AS project_key", "id AS project_id")})
    schema = T.StructType([T.StructField("project_key", T.LongType()), T.StructField("project_id", T.LongType())])
    seed = spark.createDataFrame([(UNKNOWN_PROJECT["project_key"], UNKNOWN_PROJECT["project_id"])], schema)
    s.init_warehouse({"dim_project": schema, "fact": schema}, {"dim_project": seed})
    fresh = Store(spark, s.base)
    assert [tuple(r) for r in fresh.read("dim_project").collect()] == [(-1, 0)]
    assert fresh.read("fact").count() == 0


def test_append_writes_only_new_rows_and_compacts(spark):
    s = Store(spark, os.path.join(_tmp(), "dw"))
    s.publish({"fact": spark.range(10).selectExpr("id", "CAST(id % 3 AS INT) AS review_year")})
    s.append_table("fact", spark.range(10, 12).selectExpr("id", "CAST(id % 3 AS INT) AS review_year"))
    assert len(s.tables()["fact"]) == 2
    fresh = Store(spark, s.base)
    assert fresh.read("fact").count() == 12 and fresh.read("fact").filter("review_year = 1").count() == 4
    s.compact("fact")
    assert len(Store(spark, s.base).tables()["fact"]) == 1 and Store(spark, s.base).read("fact").count() == 12


def test_a_crashed_load_does_not_block_the_next(spark, tmp_path):
    base = str(tmp_path / "store")
    Store(spark, base).publish({"t": spark.range(3)})
    Store(spark, base).stage("t", spark.range(5))            # crash before the commit: the object is gone
    s = Store(spark, base)
    s.publish({"t": spark.range(7)})
    assert Store(spark, base).read("t").count() == 7
    (tmp_path / "store" / "_log" / ".draft").write_text("{")      # crash inside the commit: a draft that got no number
    s2 = Store(spark, base)
    s2.append_table("t", spark.range(2))
    assert Store(spark, base).read("t").count() == 9


def test_malformed_rows_are_rejected_not_loaded(spark, tmp_path):
    from starloom.plans import core_load as CL
    from starloom.sources import staging as ST
    (tmp_path / "stg_reviews.csv").write_text(
        "review_id,employee_id,project_id,review_date,performance_rating,job_satisfaction,environment_satisfaction,"
        "work_life_balance,percent_salary_hike,review_score\n1,1,,2020-01-01,3,3,3,3,12,90.0\n2,x,,2020-01-02,3,3,3,3,12,90.0\n"
        "3,1,,2020-01-03,3,3,3,3,oops,90.0\n,1,,2020-01-04,3,3,3,3,12,90.0\n")
    r = ST.read_staging(spark, str(tmp_path), "stg_reviews")
    empty = lambda cols: spark.createDataFrame([], cols)
    stg = CL.Staging(empty("employee_id int"), empty("employee_id int, effective_start date"), empty("project_id int"),
                     empty("employee_id int, project_id int"), r)
    rejects = {(x["staging"], x["reason"]) for x in CL.staging_rejects(stg).collect()}
    assert rejects == {("reviews", "row:malformed"), ("reviews", "review_id:missing")}
    assert [x["review_id"] for x in CL.accepted_staging(stg).reviews.filter("review_id is not null").collect()] == [1]
