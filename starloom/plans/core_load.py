"""Staging -> conformed core.

Seven set-based loads, each "clean, resolve lookups, skip what is already
loaded": departments and job roles from the distinct cleaned names, the
latest snapshot row per employee, job history, projects, assignments and
one review per employee-day.  ``run_core_load`` builds all seven frames,
checks the keys (the constraints a relational store would enforce) and only
then returns the new core, so a failing batch changes nothing.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_email, clean_text, yes_no
from ..operators.joins import bounded_broadcast, drop_orphans, not_in
from ..operators.quality import check_unique, constraint_report, stack_reports
from ..operators.setops import assign_keys, union_distinct
from ..operators.windows import first_per
from ..schemas import CORE_RULES
from .model import Core


@dataclass
class Staging:
    snapshot: DataFrame      # stg_employee_snapshot
    history: DataFrame       # stg_employee_history
    projects: DataFrame      # stg_projects
    assignments: DataFrame   # stg_assignments
    reviews: DataFrame       # stg_reviews
    collation: str = "binary"  # or "ci": names, titles and Yes/No compare without case

    @property
    def ci(self) -> bool:
        if self.collation not in ("binary", "ci"):
            raise ValueError(f"unknown collation {self.collation!r}")
        return self.collation == "ci"

    def fold(self, c) -> Column:
        """The value under which two texts are the same."""
        c = F.col(c) if isinstance(c, str) else c
        return F.lower(c) if self.ci else c


def _names(df: DataFrame, col: str, alias: str) -> DataFrame:
    return df.select(clean_text(col).alias(alias)).filter(F.col(alias).isNotNull())


def _distinct_names(stg: Staging, names: DataFrame, col: str, existing: DataFrame | None) -> DataFrame:
    """Under "ci", one spelling (the first) per folded name, and none that the
    table already has in some spelling."""
    if not stg.ci:
        return names
    one = names.groupBy(F.lower(col).alias("_k")).agg(F.min(col).alias(col))
    if existing is not None:
        one = one.join(existing.select(F.lower(col).alias("_k")).distinct(), "_k", "left_anti")
    return one.select(col)


def load_departments(stg: Staging, existing: DataFrame | None = None) -> DataFrame:
    """All departments: existing ones plus new cleaned names (ids continue)."""
    names = union_distinct(_names(stg.snapshot, "department", "department_name"),
                           _names(stg.history, "department", "department_name"),
                           _names(stg.projects, "department", "department_name"))
    names = _distinct_names(stg, names, "department_name", existing)
    if existing is None:
        return assign_keys(names, None, ["department_name"], "department_id", few=True) \
            .select(F.col("department_id").cast("int"), "department_name")
    new = assign_keys(names, existing.withColumn("department_id", F.col("department_id").cast("long")),
                      ["department_name"], "department_id", few=True)
    return existing.unionByName(new.select(F.col("department_id").cast("int"), "department_name"))


def load_job_roles(stg: Staging, existing: DataFrame | None = None) -> DataFrame:
    names = union_distinct(_names(stg.snapshot, "job_role", "job_title"),
                           _names(stg.history, "job_role", "job_title"))
    names = _distinct_names(stg, names, "job_title", existing)
    if existing is None:
        return assign_keys(names, None, ["job_title"], "job_role_id", few=True) \
            .select(F.col("job_role_id").cast("int"), "job_title")
    new = assign_keys(names, existing.withColumn("job_role_id", F.col("job_role_id").cast("long")),
                      ["job_title"], "job_role_id", few=True)
    return existing.unionByName(new.select(F.col("job_role_id").cast("int"), "job_title"))


EMPLOYEE_COLS = ["employee_id", "first_name", "last_name", "email", "gender", "age", "marital_status",
                 "education_level", "education_field", "hire_date", "distance_from_home", "business_travel",
                 "over_time", "stock_option_level", "total_working_years", "num_companies_worked", "attrition",
                 "department_id", "job_role_id", "job_level", "monthly_income"]


def load_employees(stg: Staging, departments: DataFrame, job_roles: DataFrame,
                   existing: DataFrame | None = None) -> DataFrame:
    """New employees: latest snapshot row per id (hire_date DESC, cleaned values
    as tie-break), cleaned, with department and role ids (unknown names drop)."""
    s = stg.snapshot.filter(F.col("employee_id").isNotNull())
    clean = s.select(
        "employee_id", clean_text("first_name").alias("first_name"), clean_text("last_name").alias("last_name"),
        clean_email("email").alias("email"), clean_text("gender").alias("gender"), "age",
        clean_text("marital_status").alias("marital_status"), F.col("education").alias("education_level"),
        clean_text("education_field").alias("education_field"), "hire_date", "distance_from_home",
        clean_text("business_travel").alias("business_travel"), yes_no("over_time", stg.ci).alias("over_time"),
        "stock_option_level", "total_working_years", "num_companies_worked", yes_no("attrition", stg.ci).alias("attrition"),
        stg.fold(clean_text("department")).alias("_dept"), stg.fold(clean_text("job_role")).alias("_role"), "job_level",
        "monthly_income")
    latest = first_per(clean, ["employee_id"], [F.col("hire_date").desc_nulls_last(), "email", "first_name",
                                               "last_name", "_dept", "_role"])
    d = bounded_broadcast(departments.select(stg.fold("department_name").alias("_dept"), "department_id"))
    r = bounded_broadcast(job_roles.select(stg.fold("job_title").alias("_role"), "job_role_id"))
    out = latest.join(d, "_dept", "inner").join(r, "_role", "inner").select(*EMPLOYEE_COLS)
    return out if existing is None else not_in(out, existing, "employee_id")


HISTORY_COLS = ["employee_id", "department_id", "job_role_id", "job_level", "monthly_income", "effective_start",
                "effective_end", "change_reason"]


def load_job_history(stg: Staging, employees: DataFrame, departments: DataFrame, job_roles: DataFrame,
                     existing: DataFrame | None = None) -> DataFrame:
    h = drop_orphans(stg.history, employees, "employee_id")
    d = bounded_broadcast(departments.select(stg.fold("department_name").alias("_dept"), "department_id"))
    r = bounded_broadcast(job_roles.select(stg.fold("job_title").alias("_role"), "job_role_id"))
    h = h.withColumn("_dept", stg.fold(clean_text("department"))).withColumn("_role", stg.fold(clean_text("job_role")))
    out = h.join(d, "_dept", "inner").join(r, "_role", "inner").select(*HISTORY_COLS)
    return out if existing is None else not_in(out, existing, ["employee_id", "effective_start"])


PROJECT_COLS = ["project_id", "project_name", "department_id", "status", "priority", "budget", "start_date",
                "end_date"]


def load_projects(stg: Staging, departments: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    d = bounded_broadcast(departments.select(stg.fold("department_name").alias("_dept"), "department_id"))
    p = stg.projects.withColumn("project_name", clean_text("project_name")) \
        .withColumn("_dept", stg.fold(clean_text("department")))
    out = p.join(d, "_dept", "inner").select(*PROJECT_COLS)
    return out if existing is None else not_in(out, existing, "project_id")


ASSIGNMENT_COLS = ["employee_id", "project_id", "role_on_project", "allocation_pct", "start_date", "end_date"]


def load_assignments(stg: Staging, employees: DataFrame, projects: DataFrame,
                     existing: DataFrame | None = None) -> DataFrame:
    a = drop_orphans(drop_orphans(stg.assignments, employees, "employee_id"), projects, "project_id")
    out = a.select(*ASSIGNMENT_COLS)
    return out if existing is None else not_in(out, existing, ["employee_id", "project_id"])


REVIEW_COLS = ["review_id", "employee_id", "project_id", "review_date", "performance_rating", "job_satisfaction",
               "environment_satisfaction", "work_life_balance", "percent_salary_hike", "review_score"]


def load_reviews(stg: Staging, employees: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One review per employee-day (lowest review_id), known employees only,
    skipping employee-days already loaded."""
    r = first_per(stg.reviews, ["employee_id", "review_date"], ["review_id"])
    r = drop_orphans(r, employees, "employee_id").select(*REVIEW_COLS)
    return r if existing is None else not_in(r, existing, ["employee_id", "review_date"])


class LoadRejected(Exception):
    pass


# Keys and references that the loads guarantee by construction: distinct names, one review per employee-day,
# inner joins and orphan drops.  The gate does not check them again.
BY_CONSTRUCTION_KEYS = {("departments", ("department_name",)), ("job_roles", ("job_title",)),
                        ("performance_reviews", ("employee_id", "review_date"))}
BY_CONSTRUCTION_FKS = {(t, c) for t, r in CORE_RULES.items() for c, _, _ in r.foreign} - {("performance_reviews", "project_id")}


def core_frames(c: Core) -> dict[str, DataFrame]:
    """The core's tables under the names of ``schemas.CORE_RULES``."""
    named = {"departments": c.departments, "job_roles": c.job_roles, "employees": c.employees, "employee_job_history": c.history,
             "projects": c.projects, "project_assignments": c.assignments, "performance_reviews": c.reviews}
    return {k: v for k, v in named.items() if v is not None}


def core_gate(added: Core, previous: Core | None = None, ci: bool = False) -> DataFrame:
    """Declared constraints of the rows this load adds, as one report: NOT
    NULL and CHECK conditions in one scan a table, keys among the added rows
    and against the previous core, and the references a load does not
    guarantee itself.  Existing rows were checked when they were loaded."""
    a = added
    if ci:  # names are keys without regard to case
        low = lambda d: None if d is None else d.withColumn("project_name", F.lower("project_name"))
        a = a.with_(projects=low(a.projects))
        previous = previous and previous.with_(projects=low(previous.projects))
    projects = a.projects if previous is None else previous.projects.unionByName(a.projects)
    ids = {"projects": ["project_id"], "performance_reviews": ["review_id"]}
    reps = [constraint_report(core_frames(a), CORE_RULES, {"projects": projects}, skip_keys=BY_CONSTRUCTION_KEYS, skip_fks=BY_CONSTRUCTION_FKS)]
    reps += [check_unique(core_frames(a)[t], t, k)[0] for t, k in ids.items()]
    if previous is not None:
        reps += [_collisions(a.employees, previous.employees, "employees", ["email"]),
                 _collisions(a.projects, previous.projects, "projects", ["project_name"]),
                 _collisions(a.reviews, previous.reviews, "performance_reviews", ["review_id"])]
    return stack_reports(reps)


def assert_clean(report: DataFrame) -> None:
    """Raise with every violated constraint of a (small) report."""
    bad = report.filter(F.col("n_violations") > 0).collect()
    if bad:
        raise LoadRejected("; ".join(f"{r['constraint']} {r['table_name']}({r['columns']}): {r['n_violations']}" for r in bad))


def staging_rejects(stg: "Staging") -> DataFrame:
    """Staging rows that no load takes, with the reason: text the declared
    types could not parse, and rows without the key of their table.  They are
    reported here and kept out of the core."""
    keys = {"snapshot": ["employee_id"], "history": ["employee_id", "effective_start"], "projects": ["project_id"],
            "assignments": ["employee_id", "project_id"], "reviews": ["review_id", "employee_id", "review_date"]}
    out = []
    for name, cols in keys.items():
        df = getattr(stg, name)
        corrupt = F.col("_corrupt") if "_corrupt" in df.columns else F.lit(None).cast("string")
        missing = [F.when(F.col(c).isNull(), F.lit(f"{c}:missing")) for c in cols]
        reason = F.coalesce(F.when(corrupt.isNotNull(), F.lit("row:malformed")), *missing)
        row = F.to_json(F.struct(*[c for c in df.columns if c != "_corrupt"]))
        out.append(df.select(F.lit(name).alias("staging"), reason.alias("reason"), F.coalesce(corrupt, row).alias("row"))
                   .filter(F.col("reason").isNotNull()))
    return reduce(DataFrame.unionByName, out)


def accepted_staging(stg: "Staging") -> "Staging":
    """Staging without malformed rows (rows without a key fall out of the
    loads themselves)."""
    keep = lambda df: df.filter(F.col("_corrupt").isNull()).drop("_corrupt") if "_corrupt" in df.columns else df
    return Staging(*[keep(getattr(stg, f)) for f in ("snapshot", "history", "projects", "assignments", "reviews")], stg.collation)


def _collisions(new: DataFrame, old: DataFrame, table: str, keys) -> DataFrame:
    hit = new.join(old.select(*keys).distinct(), list(keys), "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("unique").alias("constraint"), F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("columns"),
        F.col("n").cast("bigint").alias("n_violations"))


def _together(*loads):
    """Results of loads that do not depend on each other, submitted at once:
    the tasks of one fill the cores that the end of another leaves idle."""
    with ThreadPoolExecutor(len(loads)) as pool:
        return [f.result() for f in [pool.submit(load) for load in loads]]


def run_core_load(stg: Staging, core: Core | None = None, gate: bool = True,
                  materialize_tables: bool = True) -> Core:
    """All seven loads; returns the next core (existing rows + new rows).

    The two lookups are written first (small; every later load joins them).
    With ``materialize_tables`` each new core table is written once too, so
    the gate and the caller read it instead of re-running the load.
    With ``gate`` the key report is evaluated (one small action) and any
    violation raises before anything is published."""
    from ..session import materialize
    keep = materialize if materialize_tables else (lambda d: d)
    stg = accepted_staging(stg)
    old = core or Core(*[None] * 5)
    # small lookups joined by every later load: written once, then scanned
    dep, rol = _together(lambda: materialize(load_departments(stg, old.departments)), lambda: materialize(load_job_roles(stg, old.job_roles)))
    both = lambda a, b: b if a is None else a.unionByName(b)
    # employees and projects first: the other loads read what was written
    emp_new, prj_new = _together(lambda: keep(load_employees(stg, dep, rol, old.employees)), lambda: keep(load_projects(stg, dep, old.projects)))
    emp, prj = both(old.employees, emp_new), both(old.projects, prj_new)
    his_new, asg_new, rev_new = _together(lambda: keep(load_job_history(stg, emp, dep, rol, old.history)),
                                          lambda: keep(load_assignments(stg, emp, prj, old.assignments)),
                                          lambda: keep(load_reviews(stg, emp, old.reviews)))
    added = Core(departments=dep, job_roles=rol, employees=emp_new, history=his_new, projects=prj_new,
                 assignments=asg_new, reviews=rev_new)
    if gate:
        assert_clean(core_gate(added, core, stg.ci))
    return Core(departments=dep, job_roles=rol, employees=emp, history=both(old.history, his_new), projects=prj,
                assignments=both(old.assignments, asg_new), reviews=both(old.reviews, rev_new))


def core_for_warehouse(core: Core) -> Core:
    """Core as the warehouse plans read it: employees carry full_name."""
    from ..functions.text import full_name
    e = core.employees.withColumn("full_name", full_name("first_name", "last_name"))
    return core.with_(employees=e)
