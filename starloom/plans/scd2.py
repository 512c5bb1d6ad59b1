"""Type 2 employee dimension.

``timeline`` turns the job history into versions (end = next start - 1 day,
the last version open until 9999-12-31); ``refresh_dim_employee`` merges them
into the existing dimension in one full-outer pass on (employee_id,
start_date): matched rows get their end date, current flag and the Type 1
attributes refreshed, unseen versions are added with a new key, rows no
longer produced by the history are kept (nothing is deleted).
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import open_end
from ..operators.filters import maybe_keys
from ..operators.joins import bounded_broadcast
from ..operators.setops import hash_key
from ..operators.windows import keyed_lead

# Columns refreshed on every version (Type 1); all others are
# written when a version is first inserted.
TYPE1 = ["end_date", "is_current", "full_name", "age", "marital_status", "attrition_flag", "over_time_flag"]

# Employee attributes carried into the dimension.
EMPLOYEE_ATTRS = ["full_name", "gender", "age", "marital_status", "education_level", "education_field",
                  "hire_date", "attrition", "over_time"]
# employee column -> dimension column
_RENAMES = {"attrition": "attrition_flag", "over_time": "over_time_flag"}


def timeline(history: DataFrame, employees: DataFrame, departments: DataFrame,
             job_roles: DataFrame | None = None, keys=None) -> DataFrame:
    """All versions of the selected employees (``keys``: None = all, a scalar,
    a list or a DataFrame of employee_id).  The stored effective_end is
    ignored, so gaps and overlaps in the source are closed."""
    h = maybe_keys(history, "employee_id", keys)
    t = keyed_lead(h, "employee_id", "effective_start", "effective_start", "_next")
    t = t.select(
        "*",
        F.col("effective_start").alias("start_date"),
        F.coalesce(F.date_sub("_next", 1), open_end()).alias("end_date"),
        F.col("_next").isNull().cast("int").alias("is_current"))
    if "job_role" not in t.columns and job_roles is not None:
        jr = bounded_broadcast(job_roles.select("job_role_id", F.col("job_title").alias("job_role")))
        t = t.join(jr, "job_role_id", "inner")
    d = bounded_broadcast(departments.select("department_id", "department_name"))
    t = t.join(d, "department_id", "inner")
    emp_cols = ["employee_id"] + [c for c in EMPLOYEE_ATTRS if c in employees.columns]
    e = employees.select(*[F.col(c).alias(_RENAMES.get(c, c)) for c in emp_cols])
    t = t.join(e, "employee_id", "inner")
    keep = ["employee_id", "start_date", "end_date", "is_current"]
    keep += [c for c in e.columns if c != "employee_id"]
    keep += [c for c in ("department_name", "job_role", "job_level", "monthly_income", "change_reason")
             if c in t.columns]
    return t.select(*keep)


def refresh_dim_employee(versions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Merge versions into the dimension (see module doc).  Keys are a stable
    hash of (employee_id, start_date), so reruns never re-key a version."""
    if existing is None:
        return versions.select(hash_key("employee_id", "start_date").alias("employee_key"), *versions.columns)
    bk = ["employee_id", "start_date"]
    v = versions.select(*bk, *[F.col(c).alias(f"_v_{c}") for c in versions.columns if c not in bk],
                        F.lit(True).alias("_v"))
    d = existing.withColumn("_d", F.lit(True))
    j = d.join(v, bk, "full_outer")
    only_new = F.col("_d").isNull()
    cols = []
    for c in existing.columns:
        if c == "employee_key":
            cols.append(F.when(only_new, hash_key("employee_id", "start_date"))
                        .otherwise(F.col(c)).alias(c))
        elif c in bk:
            cols.append(F.col(c))
        elif f"_v_{c}" not in j.columns:
            cols.append(F.col(c))
        elif c in TYPE1:
            cols.append(F.when(F.col("_v").isNotNull(), F.col(f"_v_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(only_new, F.col(f"_v_{c}")).otherwise(F.col(c)).alias(c))
    return j.select(*cols)


def changed_versions(versions: DataFrame, existing: DataFrame) -> DataFrame:
    """Versions whose Type 1 values differ from the stored row (what an
    in-place UPDATE would touch); NULL-safe comparison."""
    bk = ["employee_id", "start_date"]
    cols = [c for c in TYPE1 if c in versions.columns and c in existing.columns]
    e = existing.select(*bk, *[F.col(c).alias(f"_o_{c}") for c in cols])
    j = versions.join(e, bk, "inner")
    diff = F.lit(False)
    for c in cols:
        diff = diff | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return j.filter(diff).select(*versions.columns)


def scd2_refresh(history: DataFrame, employees: DataFrame, departments: DataFrame,
                 existing: DataFrame | None = None, job_roles: DataFrame | None = None,
                 keys=None) -> DataFrame:
    """Timeline + merge for all employees or a key / key set."""
    return refresh_dim_employee(timeline(history, employees, departments, job_roles, keys), existing)


def refresh_keys(history: DataFrame, employees: DataFrame, departments: DataFrame, existing: DataFrame, keys: DataFrame,
                 job_roles: DataFrame | None = None) -> DataFrame:
    """The next rows of the given employees alone (``keys``: employee_id).
    Only their history and their stored rows are read past the semi-joins and
    only they come back, so a caller writes those keys and no other."""
    k = keys.select("employee_id").distinct()
    own = existing.join(k, "employee_id", "left_semi").select(*existing.columns)
    return scd2_refresh(history, employees, departments, own, job_roles, k)


def type1_refresh_only(dim: DataFrame, versions: DataFrame, cols: Sequence[str] = TYPE1) -> DataFrame:
    """Expire/refresh step alone: update matched rows, add nothing."""
    from ..operators.joins import overwrite
    use = [c for c in cols if c in versions.columns and c in dim.columns]
    return overwrite(dim, versions, ["employee_id", "start_date"], use)


def new_versions(dim: DataFrame, versions: DataFrame) -> DataFrame:
    """Insert step alone: versions not yet in the dimension, with new keys."""
    fresh = versions.join(dim.select("employee_id", "start_date"), ["employee_id", "start_date"], "left_anti")
    return fresh.select(hash_key("employee_id", "start_date").alias("employee_key"), *versions.columns)
