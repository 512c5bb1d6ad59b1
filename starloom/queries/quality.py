"""Data-quality and validation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..plans import core_load as CL
from ..registry import query
from ..schemas import CORE_RULES, WAREHOUSE_RULES
from ..sources.fixtures import Fixture, fixture_warehouse
from .loading import CORE_CTES, REVIEWS_SQL


def fx(spark, sf) -> Fixture:
    return Fixture(spark, sf)


# ------------------------------------------------------- declared constraints
# The checked tables are the loaded core and the warehouse, with violations planted by modulus of an id.
RULES = CORE_RULES | WAREHOUSE_RULES
ID = {"departments": "department_id", "job_roles": "job_role_id", "employees": "employee_id", "employee_job_history": "employee_id",
      "projects": "project_id", "project_assignments": "employee_id", "performance_reviews": "review_id", "dim_date": "date_key",
      "dim_department": "department_id", "dim_project": "project_id", "dim_employee": "employee_id", "fact_performance_reviews": "review_id"}
TABLES_SQL = CORE_CTES + f""", q_employee_job_history AS (
  SELECT h.*, d.department_id, r.job_role_id FROM fx_stg_history h JOIN deps d ON d.department_name = trim(h.department)
  JOIN roles r ON r.job_title = trim(h.job_role) WHERE h.employee_id IN (SELECT employee_id FROM emps)),
q_project_assignments AS (SELECT * FROM fx_stg_assignment WHERE employee_id IN (SELECT employee_id FROM emps)
  AND project_id IN (SELECT project_id FROM prjs)),
q_performance_reviews AS ({REVIEWS_SQL})"""
FROM = {"departments": "deps", "job_roles": "roles", "employees": "emps", "employee_job_history": "q_employee_job_history", "projects": "prjs",
        "project_assignments": "q_project_assignments", "performance_reviews": "q_performance_reviews", "dim_date": "o_dim_date",
        "dim_department": "fx_department", "dim_project": "o_dim_project", "dim_employee": "o_dim_employee", "fact_performance_reviews": "o_fact"}
# Surrogate keys have no value in the expected tables; these stand for them (never NULL, as distinct as the rows).
SURROGATES = {"department_key": "department_id", "project_key": "project_id", "employee_key": "concat(employee_id, '/', start_date)",
              ("fact_performance_reviews", "employee_key"): "1", ("fact_performance_reviews", "department_key"): "1",
              ("fact_performance_reviews", "project_key"): "1"}
# Attributes that the fixture employees do not carry.
ABSENT = {"dim_employee": {"gender", "marital_status", "education_level", "education_field", "hire_date"}}


def _sql_col(table: str, col: str) -> str:
    return SURROGATES.get((table, col), SURROGATES.get(col, col)) if table in WAREHOUSE_RULES else col


def _not_null_cols(table: str) -> list[str]:
    return [c for c in RULES[table].not_null if c not in ABSENT.get(table, ())]


def _frames(spark, sf) -> dict:
    core = CL.run_core_load(fx(spark, sf).staging(), gate=False)
    dw = fixture_warehouse(spark, sf)
    return CL.core_frames(core) | {"dim_date": dw.dim_date, "dim_department": dw.dim_department, "dim_project": dw.dim_project,
                                   "dim_employee": dw.dim_employee, "fact_performance_reviews": dw.fact}


def _report_sql(kind: str, table: str, columns: str, count: str) -> str:
    return f"SELECT '{kind}' \"constraint\", '{table}' table_name, '{columns}' \"columns\", CAST(({count}) AS BIGINT) n_violations"


@query("dq_not_null", TABLES_SQL + "\n" + "\nUNION ALL ".join(
    _report_sql("not_null", t, c, f"SELECT count(*) FILTER (WHERE {ID[t]} % {5 + i} = 0 OR {_sql_col(t, c)} IS NULL) FROM {FROM[t]}")
    for t in RULES for i, c in enumerate(_not_null_cols(t))))
def dq_not_null(spark, sf):
    """Every declared NOT NULL column; column i is NULL where the id is
    divisible by 5 + i."""
    out = []
    for t, df in _frames(spark, sf).items():
        cols = _not_null_cols(t)
        gaps = df.select(*[F.when(F.col(ID[t]) % (5 + i) != 0, F.col(c)).alias(c) for i, c in enumerate(cols)])
        out.append(Q.check_columns(gaps, t, cols, ()))
    return Q.stack_reports(out)


def _dup_sql(t: str, keys) -> str:
    cols = [f"{_sql_col(t, c)} k{i}" for i, c in enumerate(keys)]
    names = ", ".join(f"k{i}" for i in range(len(keys)))
    src = f"SELECT {', '.join(cols)} FROM {FROM[t]} UNION ALL SELECT {', '.join(cols)} FROM {FROM[t]} WHERE {ID[t]} % 5 = 0"
    return _report_sql("unique", t, ",".join(keys), f"SELECT count(*) FROM (SELECT {names} FROM ({src}) x GROUP BY {names} HAVING count(*) > 1) y")


@query("dq_unique", TABLES_SQL + "\n" + "\nUNION ALL ".join(_dup_sql(t, k) for t, r in RULES.items() for k in r.keys))
def dq_unique(spark, sf):
    """Every declared key; rows whose id is divisible by 5 are there twice."""
    return Q.stack_reports([Q.check_unique(df.unionByName(df.filter(F.col(ID[t]) % 5 == 0)), t, k)[0]
                            for t, df in _frames(spark, sf).items() for k in RULES[t].keys])


@query("dq_unique_rejects", """
SELECT r.review_id, r.employee_id, r.review_date FROM fx_review r JOIN
  (SELECT employee_id, review_date FROM fx_review GROUP BY employee_id, review_date HAVING count(*) > 1) d
  ON d.employee_id = r.employee_id AND d.review_date = r.review_date""")
def dq_unique_rejects(spark, sf):
    _, rejects = Q.check_unique(fx(spark, sf).review(), "fx_review", ["employee_id", "review_date"])
    return rejects.select("review_id", "employee_id", "review_date")


# Parents with planted gaps: (Spark filter, the same rows in SQL).  Fact rows are counted through the dimension row they came from.
FACT_FKS = {
    "employee_key": ("is_current = 1", "SELECT count(*) FROM o_fact f JOIN o_dim_employee e ON e.employee_id = f.employee_id AND e.start_date = f.start_date WHERE e.is_current = 0"),
    "department_key": ("department_name < 'M'", "SELECT count(*) FROM o_fact WHERE department_name >= 'M'"),
    "project_key": ("project_id % 3 <> 0", "SELECT count(*) FROM o_fact WHERE project_id = -1 OR project_id % 3 = 0"),
    "date_key": ("is_weekend = 0", "SELECT count(*) FROM o_fact f JOIN o_dim_date d ON d.date_key = f.date_key WHERE d.is_weekend = 1"),
}


def _fk_count(t: str, c: str, p: str, pc: str) -> str:
    if t in WAREHOUSE_RULES:
        return FACT_FKS[c][1]
    return f"SELECT count(*) FROM {FROM[t]} c LEFT JOIN (SELECT DISTINCT {pc} pk FROM {FROM[p]} WHERE {pc} % 4 <> 0) p ON p.pk = c.{c} WHERE c.{c} IS NOT NULL AND p.pk IS NULL"


@query("dq_foreign_key", TABLES_SQL + "\n" + "\nUNION ALL ".join(
    _report_sql("foreign_key", t, c, _fk_count(t, c, p, pc)) for t, r in RULES.items() for c, p, pc in r.foreign))
def dq_foreign_key(spark, sf):
    """Every declared reference; some parent rows are taken away."""
    f = _frames(spark, sf)
    gap = lambda t, c, p, pc: f[p].filter(FACT_FKS[c][0] if t in WAREHOUSE_RULES else f"{pc} % 4 <> 0")
    return Q.stack_reports([Q.check_fk(f[t], gap(t, c, p, pc), t, [c], [pc])[0] for t, r in RULES.items() for c, p, pc in r.foreign])


# Entry batches with planted invalid values, checked with the declared conditions of their tables.
CHECKED = {"employees": "fx_entry_employee", "project_assignments": "(SELECT allocation_pct - 20 allocation_pct FROM fx_assignment)",
           "performance_reviews": "fx_entry_review"}


@query("dq_check", "\nUNION ALL ".join(
    _report_sql("check", t, n, f"SELECT count(*) FILTER (WHERE NOT ({sql})) FROM {src} x") for t, src in CHECKED.items() for n, _, sql in RULES[t].checks))
def dq_check(spark, sf):
    f = fx(spark, sf)
    frames = {"employees": f.entry_employee(), "performance_reviews": f.entry_review(),
              "project_assignments": f.assignment().withColumn("allocation_pct", F.col("allocation_pct") - 20)}
    return Q.stack_reports([Q.check_columns(frames[t], t, (), [(n, sql) for n, _, sql in RULES[t].checks]) for t in CHECKED])


def _in(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


DOMAINS = [("fx_entry_project", "status", Q.PROJECT_STATUSES), ("fx_entry_project", "priority", Q.PROJECT_PRIORITIES),
           ("fx_stg_employee", "business_travel", ("Travel_Rarely", "Travel_Frequently", "Non-Travel")),
           ("fx_stg_assignment", "role_on_project", Q.ASSIGNMENT_ROLES[:2])]


@query("dq_domain", "\nUNION ALL ".join(
    f"SELECT 'domain' \"constraint\", '{t}' table_name, '{c}' \"columns\", "
    f"CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({_in(v)})) AS BIGINT) n_violations FROM {t}"
    for t, c, v in DOMAINS))
def dq_domain(spark, sf):
    f = fx(spark, sf)
    frames = {"fx_entry_project": f.entry_project(), "fx_stg_employee": f.stg_employee(), "fx_stg_assignment": f.stg_assignment()}
    return Q.stack_reports([Q.check_domain(frames[t], t, c, v)[0] for t, c, v in DOMAINS])


STRIP = "regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"


def _text_sql(c: str, n: int) -> list[str]:
    v = STRIP.format(c=c)
    return [f"CASE WHEN {v} = '' THEN '{c}:empty' END", f"CASE WHEN length({v}) > {n} THEN '{c}:long' END"]


def _range_sql(c: str, lo: int, hi: int) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} < {lo} OR {c} > {hi} THEN '{c}:range' END"


EM = "lower(" + STRIP.format(c="email") + ")"
EMPLOYEE_REASONS_SQL = ", ".join(
    _text_sql("first_name", 60) + _text_sql("last_name", 60) + _text_sql("email", 120)
    + [f"CASE WHEN {EM} <> '' AND NOT regexp_matches({EM}, '@[^@]*\\.[^@]*$') THEN 'email:form' END",
       _range_sql("age", 18, 70), _range_sql("job_level", 1, 5), _range_sql("education_level", 1, 5),
       "CASE WHEN coalesce(monthly_income, 0) < 1 THEN 'monthly_income:range' END"])


@query("validate_employee", f"SELECT employee_id, concat_ws('; ', {EMPLOYEE_REASONS_SQL}) reasons FROM fx_entry_employee")
def validate_employee(spark, sf):
    e = fx(spark, sf).entry_employee()
    return e.select("employee_id", Q.reasons_column(Q.employee_reasons(e)).alias("reasons"))


PROJECT_REASONS_SQL = ", ".join(
    _text_sql("project_name", 100)
    + [f"CASE WHEN coalesce(status, '') NOT IN ({_in(Q.PROJECT_STATUSES)}) THEN 'status:domain' END",
       f"CASE WHEN coalesce(priority, '') NOT IN ({_in(Q.PROJECT_PRIORITIES)}) THEN 'priority:domain' END",
       "CASE WHEN start_date IS NULL THEN 'start_date:missing' END",
       "CASE WHEN date_diff('day', start_date, end_date) < 0 THEN 'end_date:order' END",
       "CASE WHEN coalesce(budget, -1) < 0 THEN 'budget:range' END"])


@query("validate_project", f"SELECT project_id, concat_ws('; ', {PROJECT_REASONS_SQL}) reasons FROM fx_entry_project")
def validate_project(spark, sf):
    p = fx(spark, sf).entry_project()
    return p.select("project_id", Q.reasons_column(Q.project_reasons(p)).alias("reasons"))


REVIEW_REASONS_SQL = ", ".join([
    _range_sql("performance_rating", 1, 4), _range_sql("job_satisfaction", 1, 4),
    _range_sql("environment_satisfaction", 1, 4), _range_sql("work_life_balance", 1, 4),
    _range_sql("percent_salary_hike", 0, 50)])


@query("validate_review", f"SELECT review_id, concat_ws('; ', {REVIEW_REASONS_SQL}) reasons FROM fx_entry_review")
def validate_review(spark, sf):
    r = fx(spark, sf).entry_review()
    return r.select("review_id", Q.reasons_column(Q.review_reasons(r)).alias("reasons"))
