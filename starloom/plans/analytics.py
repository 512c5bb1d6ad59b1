"""Warehouse queries.  Each returns a lazy DataFrame; ORDER BY is applied
last (value checks ignore order; presentation order is kept)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flag_label
from ..operators.aggregates import avg_exact_col, avg_int_col, one_row, pct_where_col
from ..operators.joins import bounded_broadcast
from ..operators.windows import first_per, top_ranks, with_rank
from .model import Core, Warehouse


def _fact_depts(f: DataFrame, dw: Warehouse) -> DataFrame:
    dep = bounded_broadcast(dw.dim_department.select("department_key", "department_name"))
    return f.join(dep, "department_key", "inner")


def kpis(dw: Warehouse) -> DataFrame:
    """One row: current employees, reviews, average score (1 dp), attrition %
    of current employees (1 dp), employees with more than one version."""
    cur = dw.dim_employee.filter(F.col("is_current") == 1)
    a = cur.agg(F.count(F.lit(1)).alias("employees"),
                pct_where_col(F.col("attrition_flag") == 1, 1).alias("attrition_pct"))
    b = dw.fact.agg(F.count(F.lit(1)).alias("reviews"), avg_exact_col("review_score", 1).alias("avg_score"))
    c = (dw.dim_employee.groupBy("employee_id").agg(F.count(F.lit(1)).alias("_n"))
         .filter(F.col("_n") > 1).agg(F.count(F.lit(1)).alias("with_history")))
    return one_row(a, b, c).select("employees", "reviews", "avg_score", "attrition_pct", "with_history")


def review_years(dw: Warehouse) -> DataFrame:
    """Years with facts: a distinct over the fact's partition column."""
    return dw.fact.select("review_year").distinct().orderBy("review_year")


def yearly_trend(dw: Warehouse) -> DataFrame:
    """Year x department: average score and rating (2 dp), reviews, and the
    year-over-year change of the unrounded average score."""
    y = dw.fact.groupBy("review_year", "department_key").agg(
        F.avg("review_score").alias("_avg_score"),
        F.avg(F.col("performance_rating").cast("decimal(10,0)")).alias("_avg_rating"),
        F.count(F.lit(1)).alias("reviews"))
    return trend_of(_fact_depts(y, dw))


def trend_of(y: DataFrame) -> DataFrame:
    """The trend from one row per year and department (unrounded averages)."""
    w = Window.partitionBy("department_name").orderBy("review_year")
    return y.select(
        "review_year", "department_name",
        F.round("_avg_score", 2).cast("double").alias("avg_score"),
        F.round("_avg_rating", 2).cast("double").alias("avg_rating"),
        "reviews",
        F.round(F.col("_avg_score") - F.lag("_avg_score").over(w), 2).cast("double").alias("yoy_change"),
    ).orderBy("department_name", "review_year")


def top_performers(dw: Warehouse, year: int | None = None, n: int = 5,
                   by_rating: bool = True) -> DataFrame:
    """Per department, employees by dense rank of rounded average score
    (then rounded average rating); ties share a rank.

    The year is a partition of the fact: a given year reads that partition
    alone.  Employees are ranked by id; only the ranked ones meet the employee
    dimension for their name."""
    yr = F.lit(year) if year is not None else dw.fact.agg(F.max("review_year")).scalar()
    f = dw.fact.filter(F.col("review_year") == yr)
    per = f.groupBy("employee_id", "department_key").agg(
        avg_exact_col("review_score", 2).alias("avg_score"),
        avg_int_col("performance_rating", 2).alias("avg_rating"),
        F.max("employee_key").alias("employee_key"))
    order = ["avg_score"] + (["avg_rating"] if by_rating else [])
    ranked = _fact_depts(top_ranks(per, "department_key", order, n, "dept_rank", descending=True), dw)
    ranked = ranked.join(dw.dim_employee.select("employee_key", "full_name"), "employee_key", "inner")
    cols = ["department_name", F.col("dept_rank").cast("int").alias("dept_rank"), "employee_id", "full_name",
            "avg_score"] + (["avg_rating"] if by_rating else [])
    return ranked.select(*cols).orderBy("department_name", "dept_rank", "employee_id")


def attrition_by_group(dw: Warehouse) -> DataFrame:
    cur = dw.dim_employee.filter(F.col("is_current") == 1)
    g = cur.groupBy("department_name", "over_time_flag").agg(
        F.count(F.lit(1)).alias("headcount"),
        F.sum(F.col("attrition_flag").cast("bigint")).alias("leavers"),
        pct_where_col(F.col("attrition_flag") == 1, 1).alias("attrition_rate_pct"))
    return g.select("department_name", flag_label("over_time_flag", "Overtime", "No overtime").alias("overtime_group"),
                    "headcount", "leavers", "attrition_rate_pct", "over_time_flag") \
        .orderBy("department_name", "over_time_flag").drop("over_time_flag")


def attrition_risk_list(dw: Warehouse, n: int = 20) -> DataFrame:
    """Current, not-left employees scored from overtime and their latest
    review; highest risk first (inner: people without a review are out)."""
    c = dw.dim_employee.filter((F.col("is_current") == 1) & (F.col("attrition_flag") == 0))
    # the fact carries employee_id: no join to the dimension for it
    f = dw.fact.select("employee_id", "date_key", "job_satisfaction", "work_life_balance", "performance_rating", "review_score") \
        .join(c.select("employee_id"), "employee_id", "left_semi")
    latest = first_per(f, ["employee_id"], [F.col("date_key").desc()])
    j = c.select("employee_id", "full_name", "department_name", "job_role", "over_time_flag") \
        .join(latest.drop("date_key"), "employee_id", "inner")
    risk = (F.col("over_time_flag") * 2 + (F.col("job_satisfaction") <= 2).cast("int") * 2
            + (F.col("work_life_balance") <= 2).cast("int") + (F.col("performance_rating") <= 2).cast("int"))
    out = j.select("employee_id", "full_name", "department_name", "job_role",
                   flag_label("over_time_flag", "Yes", "No").alias("overtime"),
                   "job_satisfaction", "work_life_balance", "performance_rating",
                   risk.cast("int").alias("risk_score"), "review_score")
    return out.orderBy(F.col("risk_score").desc(), F.col("review_score").asc(), F.col("employee_id")) \
        .limit(n).drop("review_score")


def _project_stats(dw: Warehouse, min_reviews: int, with_people: bool) -> DataFrame:
    """Statistics per project key; names are joined to the grouped rows."""
    aggs = [F.count(F.lit(1)).alias("reviews")]
    if with_people:
        # the fact carries employee_id as a degenerate column: no join needed
        aggs.append(F.count_distinct("employee_id").cast("bigint").alias("people"))
    aggs += [avg_exact_col("review_score", 2).alias("avg_score"),
             pct_where_col(F.col("performance_rating") <= 2, 1).alias("low_rating_pct")]
    per = dw.fact.filter(F.col("project_key") != -1).groupBy("project_key").agg(*aggs).filter(F.col("reviews") >= min_reviews)
    p = dw.dim_project.select("project_key", "project_name", "department_name", "status", *(["priority"] if with_people else []))
    keep = [c for c in per.columns if c != "project_key"]
    return per.join(p, "project_key", "inner").select(*[c for c in p.columns if c != "project_key"], *keep)


def _ranked(s: DataFrame) -> DataFrame:
    # scores of 0 to 100 with two decimals: few values at any number of projects
    r = with_rank(s, ["avg_score"], False, "bottleneck_rank", few_values=True)
    return r.withColumn("bottleneck_rank", F.col("bottleneck_rank").cast("int"))


def project_bottlenecks(dw: Warehouse, min_reviews: int = 20) -> DataFrame:
    return _ranked(_project_stats(dw, min_reviews, True)).orderBy("bottleneck_rank", "project_name")


def project_bottlenecks_top10(dw: Warehouse, min_reviews: int = 20, n: int = 10) -> DataFrame:
    return _ranked(_project_stats(dw, min_reviews, False)).orderBy("bottleneck_rank", "project_name").limit(n)


def bottlenecks_head(dw: Warehouse, n: int = 15) -> DataFrame:
    return project_bottlenecks(dw).orderBy("bottleneck_rank", "project_name").limit(n)


HISTORY_COLS = ["employee_id", "full_name", "department_name", "job_role", "job_level", "monthly_income",
                "start_date", "end_date", "is_current", "change_reason"]


def employee_history(dw: Warehouse, employee_id: int) -> DataFrame:
    d = dw.dim_employee.filter(F.col("employee_id") == F.lit(employee_id))
    return d.select("employee_key", *HISTORY_COLS).orderBy("start_date")


def first_multi_version_history(dw: Warehouse) -> DataFrame:
    """History of the lowest employee_id having more than one version."""
    multi = dw.dim_employee.groupBy("employee_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    who = multi.agg(F.min("employee_id")).scalar()
    return dw.dim_employee.filter(F.col("employee_id") == who).select(*HISTORY_COLS).orderBy("start_date")


def list_departments(core: Core) -> DataFrame:
    return core.departments.select("department_id", "department_name").orderBy("department_name")


def list_job_roles(core: Core) -> DataFrame:
    return core.job_roles.select("job_role_id", "job_title").orderBy("job_title")


def list_projects(core: Core, open_only: bool = True) -> DataFrame:
    d = bounded_broadcast(core.departments.select("department_id", "department_name"))
    p = core.projects
    if open_only:
        p = p.filter(F.col("status") != "Completed")
    return p.join(d, "department_id", "inner") \
        .select("project_id", "project_name", "department_name", "status", "priority").orderBy("project_name")


def employee_profile(core: Core, employee_id: int) -> DataFrame:
    """Current row of one employee with department and role names."""
    from ..functions.text import full_name
    e = core.employees.filter(F.col("employee_id") == F.lit(employee_id))
    d = core.departments.select("department_id", "department_name")
    r = core.job_roles.select("job_role_id", "job_title")
    out = e.join(d, "department_id", "inner").join(r, "job_role_id", "inner")
    return out.select("employee_id", full_name("first_name", "last_name").alias("full_name"), "email", "hire_date",
                      "department_id", "department_name", "job_role_id", "job_title", "job_level", "monthly_income")
