"""Staging -> core: planted dirt disappears, reruns add nothing, the gate
rejects a batch with duplicate keys."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from starloom.plans import core_load as CL
from starloom.sources.fixtures import Fixture


def test_planted_dirt_is_cleaned(spark):
    stg = Fixture(spark, SF_SMALL).staging()
    assert stg.snapshot.groupBy("employee_id").count().filter("count > 1").count() > 0
    core = CL.run_core_load(stg)
    e = core.employees
    assert e.groupBy("employee_id").count().filter("count > 1").count() == 0
    assert e.filter(F.col("email") != F.lower("email")).count() == 0
    assert e.filter(F.col("first_name") != F.trim("first_name")).count() == 0
    # the duplicate (older hire date) lost against the original row
    orig = stg.snapshot.groupBy("employee_id").agg(F.max("hire_date").alias("h"))
    assert e.join(orig, "employee_id").filter(F.col("hire_date") != F.col("h")).count() == 0
    assert core.reviews.groupBy("employee_id", "review_date").count().filter("count > 1").count() == 0


def test_second_load_adds_nothing(spark):
    stg = Fixture(spark, SF_SMALL).staging()
    c1 = CL.run_core_load(stg)
    c2 = CL.run_core_load(stg, c1)
    for name in ("employees", "history", "projects", "assignments", "reviews", "departments", "job_roles"):
        assert getattr(c2, name).count() == getattr(c1, name).count(), name


def test_gate_rejects_duplicate_history_keys(spark):
    stg = Fixture(spark, SF_SMALL).staging()
    bad = CL.Staging(snapshot=stg.snapshot, history=stg.history.unionByName(stg.history.limit(3)),
                     projects=stg.projects, assignments=stg.assignments, reviews=stg.reviews)
    with pytest.raises(CL.LoadRejected, match="employee_job_history"):
        CL.run_core_load(bad)


def test_gate_rejects_values_outside_the_declared_rules(spark):
    stg = Fixture(spark, SF_SMALL).staging()
    for change, name in (({"snapshot": stg.snapshot.withColumn("age", F.lit(15))}, "age_18_70"),
                         ({"snapshot": stg.snapshot.withColumn("gender", F.lit(None).cast("string"))}, "gender"),
                         ({"assignments": stg.assignments.withColumn("allocation_pct", F.lit(500))}, "allocation_1_100"),
                         ({"reviews": stg.reviews.withColumn("performance_rating", F.lit(9))}, "rating_1_4")):
        parts = {f: getattr(stg, f) for f in ("snapshot", "history", "projects", "assignments", "reviews")} | change
        with pytest.raises(CL.LoadRejected, match=name):
            CL.run_core_load(CL.Staging(**parts))
