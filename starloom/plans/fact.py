"""Incremental review fact.

Only reviews not yet loaded are considered: new by review_id and -- the
rerun guard -- by (employee_id, review day), so a dedupe loser of an earlier
run is never inserted later.  Among the new rows the lowest review_id per
employee-day wins.  Each review takes the employee version valid on its date
(inner: reviews before the first version wait for a later run), the
department by that version's name, the calendar row of its date, and the
project or the unknown member -1.
"""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_key
from ..operators.joins import asof, bounded_broadcast
from ..operators.windows import first_per

MEASURES = ["performance_rating", "job_satisfaction", "environment_satisfaction", "work_life_balance",
            "percent_salary_hike", "review_score"]
FACT_COLS = ["review_id", "employee_key", "employee_id", "department_key", "project_key", "date_key",
             *MEASURES, "review_year"]


def batch_years(reviews: DataFrame) -> list[int]:
    """Years of the raw batch (as many values as the calendar has years)."""
    rows = reviews.select(F.year("review_date").alias("y")).filter("y is not null").distinct().collect()
    return sorted(r["y"] for r in rows)


#: From keys and their columns to the fact rows that may hold them.
Known = Callable[[DataFrame, Sequence[str]], DataFrame]


def new_reviews(reviews: DataFrame, fact: DataFrame | None, years: list[int] | None = None, known: Known | None = None) -> DataFrame:
    """Reviews not in ``fact``, one per employee and day.  The fact is first
    cut down to what the batch can meet: its review ids by a semi-join (one
    column read), its employee-days by the batch's literal years, which are
    partitions of the published fact.  ``known`` (of an indexed store table:
    ``partial(store.rows_that_may_hold, "fact")``) takes the fact's place and
    gives only units that may hold the batch's ids or employee-days."""
    r = reviews.withColumn("date_key", date_key("review_date"))
    days_of = ["employee_id", "date_key"]
    if known is not None:
        r = r.join(known(reviews.select("review_id"), ["review_id"]).select("review_id"), "review_id", "left_anti")
        r = r.join(known(reviews.select("employee_id", date_key("review_date").alias("date_key")), days_of).select(*days_of), days_of, "left_anti")
    elif fact is not None:
        years = batch_years(reviews) if years is None else years
        seen = fact.select("review_id").join(reviews.select("review_id").distinct(), "review_id", "left_semi")
        r = r.join(seen.distinct(), "review_id", "left_anti")
        days = fact.filter(F.col("review_year").isin(years)).select(*days_of)
        r = r.join(days, days_of, "left_anti")
    return first_per(r, ["employee_id", "review_date"], ["review_id"])


def resolve(reviews: DataFrame, dim_employee: DataFrame, dim_department: DataFrame,
            dim_date: DataFrame, dim_project: DataFrame, calendar_rows: int | None = None,
            raw: DataFrame | None = None) -> DataFrame:
    """Star lookups for already de-duplicated reviews (no anti joins);
    ``raw`` is the undeduplicated input, used only for the date range."""
    ver = dim_employee.select("employee_key", "employee_id", "start_date", "end_date",
                              F.col("department_name").alias("_dept_name"))
    r = asof(reviews, ver, "employee_id", "review_date", bounds_from=raw)
    dd = bounded_broadcast(dim_department.select("department_key", F.col("department_name").alias("_dept_name")))
    r = r.join(dd, "_dept_name", "inner")
    dt = bounded_broadcast(dim_date.select("date_key", "year_number"), known_rows=calendar_rows)
    r = r.join(dt, "date_key", "inner")
    dp = bounded_broadcast(dim_project.filter(F.col("project_key") != -1)
                           .select(F.col("project_id").alias("_pid"), "project_key"))
    r = r.join(dp, r["project_id"] == dp["_pid"], "left")
    return r.select(
        "review_id", "employee_key", "employee_id", "department_key",
        F.coalesce("project_key", F.lit(-1).cast("long")).alias("project_key"),
        "date_key", *MEASURES, F.col("year_number").alias("review_year"))


def load_fact(reviews: DataFrame, dim_employee: DataFrame, dim_department: DataFrame,
              dim_date: DataFrame, dim_project: DataFrame, fact: DataFrame | None = None,
              calendar_rows: int | None = None, known: Known | None = None) -> DataFrame:
    """Rows to append to the fact (the caller appends / publishes them)."""
    nr = new_reviews(reviews, fact, known=known)
    return resolve(nr, dim_employee, dim_department, dim_date, dim_project, calendar_rows,
                   raw=reviews.select("review_date"))


def rekey(fact: DataFrame, reviews: DataFrame, dim_employee: DataFrame, dim_department: DataFrame, dim_date: DataFrame,
          dim_project: DataFrame) -> DataFrame:
    """The loaded facts with their keys resolved again against the dimensions
    as they are now.  No load does this on its own; it is for a history that
    was corrected after its reviews were loaded.  Facts that the dimensions
    no longer resolve drop out (``unresolved`` lists them)."""
    loaded = reviews.join(fact.select("review_id"), "review_id", "left_semi").withColumn("date_key", date_key("review_date"))
    return resolve(loaded, dim_employee, dim_department, dim_date, dim_project, raw=reviews.select("review_date"))


def unresolved(reviews: DataFrame, dim_employee: DataFrame, dim_department: DataFrame,
               dim_date: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    """New reviews the inner lookups skip, with the first reason that applies."""
    nr = new_reviews(reviews, fact).select("review_id", "employee_id", "review_date", "date_key")
    ver = dim_employee.select("employee_id", "start_date", "end_date", "department_name")
    hit = asof(nr, ver, "employee_id", "review_date", bounds_from=reviews.select("review_date")) \
        .select("review_id", "department_name", F.lit(True).alias("_version"))
    dd = dim_department.select("department_name", F.lit(True).alias("_department"))
    dt = bounded_broadcast(dim_date.select("date_key", F.lit(True).alias("_date")))
    j = nr.select("review_id", "date_key").join(hit, "review_id", "left").join(dd, "department_name", "left").join(dt, "date_key", "left")
    reason = F.when(F.col("_version").isNull(), "no employee version on the review date") \
        .when(F.col("_department").isNull(), "version department not in dim_department") \
        .when(F.col("_date").isNull(), "review date not in dim_date")
    return j.select("review_id", reason.alias("reason")).filter(F.col("reason").isNotNull())
