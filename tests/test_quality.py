"""Data-quality checks follow SQL constraint semantics for NULLs."""
from pyspark.sql import functions as F

from starloom.operators import quality as Q


def _n(report):
    return report.first()["n_violations"]


def test_null_semantics_of_checks(spark):
    df = spark.createDataFrame([(1, "a", 20), (1, "a", 17), (None, None, None), (None, None, 30), (2, "b", 80)],
                               "k int, name string, age int")
    rep, rej = Q.check_unique(df, "t", ["k", "name"])
    assert _n(rep) == 1 and rej.count() == 2          # NULL keys are not duplicates
    parent = spark.createDataFrame([(1,)], "k int")
    rep, rej = Q.check_fk(df, parent, "t", ["k"])
    assert _n(rep) == 1 and rej.first()["k"] == 2     # NULL child keys are skipped
    rep, rej = Q.check_rule(df, "t", "age_18_70", F.col("age").between(18, 70))
    assert _n(rep) == 2                               # 17 and 80 fail, NULL passes
    nn = {r["columns"]: r["n_violations"] for r in Q.check_not_null(df, "t", ["k", "age"]).collect()}
    assert nn == {"k": 2, "age": 1}
    rep, _ = Q.check_domain(df, "t", "name", ["a"])
    assert _n(rep) == 1                               # 'b' only; NULL is not a domain violation


def test_validate_splits_valid_and_rejects_with_all_reasons(spark):
    rows = [("Ann", "Lee", "ANN@X.ORG ", 30, 2, 3, 5000),
            ("  ", "Lee", "bad@nodot", 17, 6, 3, 0)]
    df = spark.createDataFrame(rows, "first_name string, last_name string, email string, age int, job_level int, "
                                     "education_level int, monthly_income int")
    valid, rejects = Q.validate_employee(df)
    v = valid.first()
    assert valid.count() == 1 and v["email"] == "ann@x.org"
    reasons = rejects.first()["reject_reasons"]
    assert reasons == ["first_name:empty", "email:form", "age:range", "job_level:range", "monthly_income:range"]


def test_null_fails_every_entry_rule(spark):
    e = spark.createDataFrame([(None,) * 7], "first_name string, last_name string, email string, age int, job_level int, education_level int, monthly_income int")
    assert Q.validate_employee(e)[1].first()["reject_reasons"] == [
        "first_name:empty", "last_name:empty", "email:empty", "age:range", "job_level:range", "education_level:range", "monthly_income:range"]
    p = spark.createDataFrame([(None,) * 6], "project_name string, status string, priority string, budget int, start_date date, end_date date")
    assert Q.validate_project(p)[1].first()["reject_reasons"] == ["project_name:empty", "status:domain", "priority:domain", "start_date:missing", "budget:range"]
    r = spark.createDataFrame([(None,) * 5, (4, 1, 2, 3, 0)], "performance_rating int, job_satisfaction int, environment_satisfaction int, "
                                                              "work_life_balance int, percent_salary_hike int")
    valid, rejects = Q.validate_review(r)
    assert valid.count() == 1 and len(rejects.first()["reject_reasons"]) == 5
