"""The reference's end-to-end scenario as an asserted test: onboard one
person, move them to another department, submit a review, refresh."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.plans import changes as CH, dims, fact as factmod, scd2
from starloom.plans.core_load import core_for_warehouse
from starloom.plans.model import Core

D = dt.date


def _core(spark):
    deps = spark.createDataFrame([(1, "Sales"), (2, "Human Resources")], "department_id int, department_name string")
    roles = spark.createDataFrame([(1, "Sales Executive")], "job_role_id int, job_title string")
    emp_schema = ("employee_id long, first_name string, last_name string, email string, gender string, age int, "
                  "marital_status string, education_level int, education_field string, hire_date date, "
                  "over_time int, attrition int, department_id int, job_role_id int, job_level int, "
                  "monthly_income int")
    hist_schema = ("employee_id long, department_id int, job_role_id int, job_level int, monthly_income int, "
                   "effective_start date, effective_end date, change_reason string")
    rev_schema = ("review_id long, employee_id long, project_id long, review_date date, performance_rating int, "
                  "job_satisfaction int, environment_satisfaction int, work_life_balance int, "
                  "percent_salary_hike int, review_score decimal(5,2)")
    proj = spark.createDataFrame([], "project_id long, project_name string, department_id int, status string, "
                                     "priority string")
    return Core(departments=deps, job_roles=roles, employees=spark.createDataFrame([], emp_schema),
                history=spark.createDataFrame([], hist_schema), projects=proj,
                reviews=spark.createDataFrame([], rev_schema))


def test_onboard_move_review(spark):
    core = _core(spark)
    onboard = spark.createDataFrame(
        [(1, "Test", "Personab12cd", "test.ab12cd@corp.example", "Female", 29, "Single", 3, "Life Sciences",
          D(2025, 3, 1), 1, 1, 2, 5200, 0, 0)],
        "seq long, first_name string, last_name string, email string, gender string, age int, "
        "marital_status string, education_level int, education_field string, hire_date date, department_id int, "
        "job_role_id int, job_level int, monthly_income int, over_time int, attrition int")
    core, acc, rej = CH.apply_onboarding(core, onboard)
    assert rej.count() == 0
    new_id = acc.select("new_employee_id").first()[0]
    assert core.history.count() == 1

    dim = scd2.scd2_refresh(core.history, core_for_warehouse(core).employees, core.departments,
                            job_roles=core.job_roles, keys=new_id)
    assert dim.count() == 1

    move = spark.createDataFrame([(1, new_id, 2, 1, D(2025, 9, 1), "Department Transfer")],
                                 "seq long, employee_id long, new_department_id int, new_job_role_id int, "
                                 "effective_date date, change_reason string")
    core, acc, rej = CH.apply_department_change(core, move)
    assert acc.count() == 1 and rej.count() == 0
    dim = scd2.scd2_refresh(core.history, core_for_warehouse(core).employees, core.departments, existing=dim,
                            job_roles=core.job_roles, keys=new_id)
    rows = [r.asDict() for r in dim.orderBy("start_date").collect()]
    assert [(r["start_date"], r["end_date"], r["is_current"], r["department_name"]) for r in rows] == [
        (D(2025, 3, 1), D(2025, 8, 31), 0, "Sales"),
        (D(2025, 9, 1), D(9999, 12, 31), 1, "Human Resources")]
    # the open history row was closed the day before the move
    h = {r["effective_start"]: r["effective_end"] for r in core.history.collect()}
    assert h == {D(2025, 3, 1): D(2025, 8, 31), D(2025, 9, 1): None}

    review = spark.createDataFrame([(7, new_id, D(2025, 12, 5), 4, 3, 3, 4, 12)],
                                   "seq long, employee_id long, review_date date, performance_rating int, "
                                   "job_satisfaction int, environment_satisfaction int, work_life_balance int, "
                                   "percent_salary_hike int")
    core, acc, rej = CH.apply_reviews(core, review)
    assert rej.count() == 0 and acc.first()["review_score"] == Decimal("93.33")

    dd = dims.dim_date(spark)
    assert dd.count() == 5844 and dd.filter("is_weekend = 1").count() == 1670
    dep = dims.dim_department(core.departments)
    prj = dims.dim_project(core.projects, core.departments)
    f = factmod.load_fact(core.reviews, dim, dep, dd, prj).collect()
    assert len(f) == 1 and f[0]["project_key"] == -1 and f[0]["date_key"] == 20251205
    v2 = [r for r in dim.collect() if r["is_current"] == 1][0]
    assert f[0]["employee_key"] == v2["employee_key"]


def test_dim_date_empty_when_end_before_start(spark):
    assert dims.dim_date(spark, "2020-01-02", "2020-01-01").count() == 0


_ = T
