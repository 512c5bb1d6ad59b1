"""Calendar and Type 1 dimensions."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import with_date_parts
from ..operators.joins import bounded_broadcast, overwrite
from ..operators.setops import assign_keys, with_unknown

# The default calendar range and the unknown project member.
DEFAULT_START = dt.date(2015, 1, 1)
DEFAULT_END = dt.date(2030, 12, 31)
UNKNOWN_PROJECT = {"project_key": -1, "project_id": 0, "project_name": "No project", "status": "n/a"}


def _d(x) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def dim_date(spark: SparkSession, start=DEFAULT_START, end=DEFAULT_END,
             existing: DataFrame | None = None) -> DataFrame:
    """Every day in [start, end] with its calendar attributes; an empty frame
    when end < start; days already in ``existing`` are not repeated."""
    s, e = _d(start), _d(end)
    n = max((e - s).days + 1, 0)
    days = spark.range(n).select(F.date_add(F.lit(s.isoformat()).cast("date"), F.col("id").cast("int"))
                                 .alias("full_date"))
    out = with_date_parts(days, "full_date").select(
        "date_key", "full_date", "day_of_month", "day_name", "month_number", "month_name",
        "quarter_number", "year_number", "is_weekend")
    if existing is not None:
        out = existing.unionByName(out.join(existing.select("date_key"), "date_key", "left_anti"))
    return out


def calendar_rows(start=DEFAULT_START, end=DEFAULT_END) -> int:
    return max((_d(end) - _d(start)).days + 1, 0)


def dim_department(departments: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Type 1: names overwritten by department_id, unseen ids added, none deleted."""
    src = departments.select("department_id", "department_name")
    if existing is None:
        return assign_keys(src, None, ["department_id"], "department_key") \
            .select("department_key", "department_id", "department_name")
    kept = overwrite(existing, src, ["department_id"], ["department_name"])
    new = assign_keys(src, existing, ["department_id"], "department_key")
    return kept.unionByName(new.select(*kept.columns))


PROJECT_T1 = ["project_name", "department_name", "status", "priority", "budget", "start_date", "end_date"]


def project_rows(projects: DataFrame, departments: DataFrame) -> DataFrame:
    """Core projects with their department name (inner: unknown department drops)."""
    d = bounded_broadcast(departments.select("department_id", "department_name"))
    p = projects.join(d, "department_id", "inner")
    cols = [F.col("project_id")]
    for c, t in [("project_name", "string"), ("department_name", "string"), ("status", "string"),
                 ("priority", "string"), ("budget", "decimal(12,2)"), ("start_date", "date"),
                 ("end_date", "date")]:
        cols.append((F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c))
    return p.select(*cols)


def dim_project(projects: DataFrame, departments: DataFrame,
                existing: DataFrame | None = None) -> DataFrame:
    """Type 1: all attributes overwritten on project_id match (also to NULL);
    unseen projects added; the unknown member (-1) is kept untouched."""
    src = project_rows(projects, departments)
    if existing is None:
        keyed = assign_keys(src, None, ["project_id"], "project_key")
        keyed = keyed.select("project_key", *src.columns)
        return with_unknown(keyed, UNKNOWN_PROJECT)
    known = existing.filter(F.col("project_key") != -1)
    unknown = existing.filter(F.col("project_key") == -1)
    kept = overwrite(known, src, ["project_id"], PROJECT_T1)
    new = assign_keys(src, existing, ["project_id"], "project_key").select(*kept.columns)
    return kept.unionByName(new).unionByName(unknown)


def dim_date_covering(df: DataFrame, date_col: str) -> DataFrame:
    """Calendar from Jan 1 of the first to Dec 31 of the last year in
    ``date_col``.  The day list is generated from one bounds row; its size is
    bounded by the number of days in the range, not by the data."""
    b = df.agg(F.make_date(F.min(F.year(date_col)), F.lit(1), F.lit(1)).alias("lo"),
               F.make_date(F.max(F.year(date_col)), F.lit(12), F.lit(31)).alias("hi"))
    days = b.select(F.explode(F.when(F.col("hi") >= F.col("lo"), F.sequence("lo", "hi"))
                              .otherwise(F.array().cast("array<date>"))).alias("full_date"))
    return with_date_parts(days, "full_date").select(
        "date_key", "full_date", "day_of_month", "day_name", "month_number", "month_name",
        "quarter_number", "year_number", "is_weekend")
