"""Rule-checked change batch queries (one status row per change)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import changes as CH
from ..plans.model import Core
from ..plans.scale import close_intervals
from ..registry import query
from ..session import materialize
from ..sources.fixtures import Fixture
from .quality import EMPLOYEE_REASONS_SQL, PROJECT_REASONS_SQL, REVIEW_REASONS_SQL


def fx(spark, sf) -> Fixture:
    return Fixture(spark, sf)


BIG = 1_000_000_000


def _core(f: Fixture, **kw) -> Core:
    base = dict(departments=f.department(), employees=f.employee(), history=f.history(), projects=f.project(),
                reviews=f.review(), assignments=f.stg_assignment())
    base.update(kw)
    return Core(**base)


# ------------------------------------------------------------------ onboarding
@query("apply_onboarding", f"""
, ch AS (SELECT e.*, CAST(employee_id AS BIGINT) seq FROM fx_entry_employee e
         UNION ALL SELECT e.*, CAST(employee_id + {BIG} AS BIGINT) FROM fx_entry_employee e WHERE employee_id % 200 = 3),
v AS (SELECT *, coalesce({EMPLOYEE_REASONS_SQL}, CASE WHEN seq % 61 = 7 THEN 'department_id:unknown' END) vr, lower(regexp_replace(email, '^\\s+|\\s+$', '', 'g')) em FROM ch),
f AS (SELECT em, min(seq) fs FROM v WHERE vr IS NULL GROUP BY em),
t AS (SELECT v.seq, coalesce(v.vr, CASE WHEN v.em IN (SELECT lower(email) FROM fx_employee WHERE attrition = 1)
                                         OR v.seq <> f.fs THEN 'email already exists' END) reason
      FROM v LEFT JOIN f ON f.em = v.em)
SELECT seq, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END status, reason,
       CASE WHEN reason IS NULL THEN (SELECT max(employee_id) FROM fx_employee WHERE attrition = 1)
            + row_number() OVER (PARTITION BY reason IS NULL ORDER BY seq) END new_employee_id
FROM t""")
def apply_onboarding(spark, sf):
    """Entry-form employees (planted invalid rows, repeated e-mails) onboarded
    into a table that already holds the leavers."""
    f = fx(spark, sf)
    e = f.entry_employee()
    batch = e.withColumn("seq", F.col("employee_id").cast("long")).unionByName(
        e.filter(F.col("employee_id") % 200 == 3).withColumn("seq", (F.col("employee_id") + BIG).cast("long")))
    batch = batch.drop("employee_id").withColumn("department_id", F.when(F.col("seq") % 61 == 7, 77).otherwise(F.lit(1) + F.col("seq") % 25).cast("int")) \
        .withColumn("job_role_id", F.lit(1))
    core = _core(f, employees=f.employee().filter(F.col("attrition") == 1),
                 history=f.history().withColumn("effective_end", F.lit(None).cast("date")))
    _, acc, rej = CH.apply_onboarding(core, batch)
    return acc.select("seq", CH.STATUS, CH.REASON, "new_employee_id").unionByName(
        rej.select("seq", CH.STATUS, CH.REASON, F.lit(None).cast("long").alias("new_employee_id")))


# ------------------------------------------------------------------ projects
@query("apply_projects", f"""
, ch AS (SELECT p.*, CAST(project_id AS BIGINT) seq FROM fx_entry_project p
         UNION ALL SELECT p.*, CAST(project_id + {BIG} AS BIGINT) FROM fx_entry_project p WHERE project_id % 7 = 2),
d AS (SELECT * REPLACE (coalesce(budget, 0) AS budget) FROM ch),
v AS (SELECT *, coalesce({PROJECT_REASONS_SQL}, CASE WHEN seq % 37 = 1 THEN 'department_id:unknown' END) vr, regexp_replace(project_name, '^\\s+|\\s+$', '', 'g') nm FROM d),
f AS (SELECT nm, min(seq) fs FROM v WHERE vr IS NULL GROUP BY nm),
t AS (SELECT v.seq, coalesce(v.vr, CASE WHEN v.nm IN (SELECT project_name FROM fx_project WHERE status = 'Completed')
                                         OR v.seq <> f.fs THEN 'project name already exists' END) reason
      FROM v LEFT JOIN f ON f.nm = v.nm)
SELECT seq, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END status, reason,
       CASE WHEN reason IS NULL THEN (SELECT max(project_id) FROM fx_project WHERE status = 'Completed')
            + row_number() OVER (PARTITION BY reason IS NULL ORDER BY seq) END new_project_id
FROM t""")
def apply_projects(spark, sf):
    f = fx(spark, sf)
    p = f.entry_project()
    batch = p.withColumn("seq", F.col("project_id").cast("long")).unionByName(
        p.filter(F.col("project_id") % 7 == 2).withColumn("seq", (F.col("project_id") + BIG).cast("long"))) \
        .drop("project_id").withColumn("department_id", F.when(F.col("seq") % 37 == 1, 99).otherwise(F.col("department_id")))
    core = _core(f, projects=f.project().filter(F.col("status") == "Completed"))
    _, acc, rej = CH.apply_projects(core, batch)
    return acc.select("seq", CH.STATUS, CH.REASON, "new_project_id").unionByName(
        rej.select("seq", CH.STATUS, CH.REASON, F.lit(None).cast("long").alias("new_project_id")))


# ------------------------------------------------------------------ reviews
@query("apply_reviews", f"""
, ch AS (SELECT review_id seq, CASE WHEN review_id % 89 = 0 THEN employee_id + 1000000 ELSE employee_id END employee_id,
                CASE WHEN review_id % 79 = 0 THEN NULL WHEN review_id % 7 = 0 THEN CAST(review_date - INTERVAL 60 DAY AS DATE)
                     ELSE review_date END review_date, review_id % 83 = 0 bad_project,
                performance_rating, job_satisfaction, environment_satisfaction, work_life_balance, percent_salary_hike
         FROM fx_entry_review),
p AS (SELECT c.*, coalesce({REVIEW_REASONS_SQL},
        CASE WHEN e.employee_id IS NULL THEN 'no such employee' WHEN c.review_date IS NULL THEN 'review_date:missing'
             WHEN c.bad_project THEN 'no such project'
             WHEN c.review_date < e.hire_date THEN 'review dated before hire date'
             WHEN EXISTS (SELECT 1 FROM fx_review r WHERE r.employee_id = c.employee_id AND r.review_date = c.review_date)
             THEN 'already has a review on that date' END) pre
      FROM ch c LEFT JOIN fx_stg_employee e ON e.employee_id = c.employee_id),
f AS (SELECT employee_id, review_date, min(seq) fs FROM p WHERE pre IS NULL GROUP BY 1, 2),
t AS (SELECT p.*, coalesce(pre, CASE WHEN p.seq <> f.fs THEN 'already has a review on that date' END) reason
      FROM p LEFT JOIN f ON f.employee_id = p.employee_id AND f.review_date = p.review_date)
SELECT seq, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END status, reason,
       CASE WHEN reason IS NULL THEN CAST(round(CAST(performance_rating AS DECIMAL(18,6)) * 15
            + CAST(job_satisfaction + environment_satisfaction + work_life_balance AS DECIMAL(18,6)) * 10 / 3, 2)
            AS DECIMAL(5,2)) END review_score,
       CASE WHEN reason IS NULL THEN (SELECT max(review_id) FROM fx_review) + row_number() OVER (PARTITION BY reason IS NULL ORDER BY seq) END review_id
FROM t""")
def apply_reviews(spark, sf):
    f = fx(spark, sf)
    r = f.entry_review()
    batch = r.select(
        F.col("review_id").alias("seq"),
        F.when(F.col("review_id") % 89 == 0, F.col("employee_id") + 1000000).otherwise(F.col("employee_id"))
         .alias("employee_id"),
        F.when(F.col("review_id") % 7 == 0, F.date_sub("review_date", 60)).otherwise(F.col("review_date")).alias("review_date"),
        F.when(F.col("review_id") % 83 == 0, 999999).cast("long").alias("project_id"),
        "performance_rating", "job_satisfaction", "environment_satisfaction", "work_life_balance",
        "percent_salary_hike").withColumn("review_date", F.when(F.col("seq") % 79 != 0, F.col("review_date")))
    core = _core(f, employees=f.stg_employee().select("employee_id", "hire_date"), reviews=f.review())
    _, acc, rej = CH.apply_reviews(core, batch)
    return acc.select("seq", CH.STATUS, CH.REASON, "review_score", "review_id").unionByName(
        rej.select("seq", CH.STATUS, CH.REASON, "review_score", F.lit(None).cast("long").alias("review_id")))


# ------------------------------------------------------------------ department moves
MOVES_SQL = """RECURSIVE
, hist AS (SELECT employee_id, department_id, effective_start,
                  CAST(lead(effective_start) OVER (PARTITION BY employee_id ORDER BY effective_start) - INTERVAL 1 DAY
                       AS DATE) effective_end FROM fx_history),
cur AS (SELECT employee_id, department_id, effective_start FROM hist WHERE effective_end IS NULL),
ch AS (SELECT o_orderkey seq, CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 1 + 1000000 ELSE o_custkey + 1 END employee_id,
              CAST(CASE WHEN o_orderkey % 79 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 99 ELSE 1 + o_orderkey % 25 END AS INT) new_department_id,
              CASE WHEN o_orderkey % 83 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + 1000 AS DATE) END effective_date FROM orders),
chn AS (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY seq) rn FROM ch),
r AS (
  SELECT e.employee_id, CAST(0 AS BIGINT) rn, CAST(NULL AS BIGINT) seq, c.department_id dept, c.effective_start st,
         CAST(NULL AS VARCHAR) status, CAST(NULL AS VARCHAR) reason
  FROM (SELECT DISTINCT employee_id FROM ch) e LEFT JOIN cur c ON c.employee_id = e.employee_id
  UNION ALL
  SELECT x.employee_id, x.rn, x.seq,
         CASE WHEN x.reason IS NULL THEN x.new_department_id ELSE x.dept END,
         CASE WHEN x.reason IS NULL THEN x.effective_date ELSE x.st END,
         CASE WHEN x.reason IS NULL THEN 'accepted' ELSE 'rejected' END, x.reason
  FROM (SELECT n.employee_id, n.rn, n.seq, n.new_department_id, n.effective_date, r.dept, r.st,
               CASE WHEN r.dept IS NULL THEN 'no active job record'
                    WHEN coalesce(n.new_department_id, 99) = 99 THEN 'no such department'
                    WHEN n.effective_date IS NULL THEN 'effective_date:missing'
                    WHEN n.new_department_id = r.dept THEN 'already in that department'
                    WHEN n.effective_date <= r.st THEN 'move must be after the current role started' END reason
        FROM r JOIN chn n ON n.employee_id = r.employee_id AND n.rn = r.rn + 1) x)"""


def _moves(spark, sf):
    """One move request per order (1000 days after it), some for unknown
    employees or departments, some without a date or a department."""
    f = fx(spark, sf)
    o = f._t("orders")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    batch = o.select(k.alias("seq"),
                     F.when(k % 97 == 0, ck + 1 + 1000000).otherwise(ck + 1).alias("employee_id"),
                     F.when(k % 79 != 0, F.when(k % 89 == 0, 99).otherwise(F.lit(1) + k % 25)).cast("int").alias("new_department_id"),
                     (F.lit(1) + k % 5).cast("int").alias("new_job_role_id"),
                     F.when(k % 83 != 0, F.date_add(F.col("o_orderdate").cast("date"), 1000)).alias("effective_date"),
                     F.lit("Department Transfer").alias("change_reason"))
    return CH.apply_department_change(_core(f, history=close_intervals(f.history(), "employee_id", "effective_start")), batch)


@query("apply_department_change", MOVES_SQL + """
SELECT seq, employee_id, status, reason FROM r WHERE rn > 0""")
def apply_department_change(spark, sf):
    """Every requested move, accepted or rejected."""
    _, acc, rej = _moves(spark, sf)
    cols = ["seq", "employee_id", CH.STATUS, CH.REASON]
    return acc.select(*cols).unionByName(rej.select(*cols))


@query("apply_department_change_history", MOVES_SQL + """
, ok AS (SELECT employee_id, rn, dept, st FROM r WHERE status = 'accepted')
SELECT h.employee_id, h.department_id, h.effective_start,
       coalesce(h.effective_end, CAST((SELECT min(st) FROM ok WHERE ok.employee_id = h.employee_id) - INTERVAL 1 DAY AS DATE)) effective_end
FROM hist h
UNION ALL
SELECT a.employee_id, a.dept, a.st, CAST(min(b.st) - INTERVAL 1 DAY AS DATE)
FROM ok a LEFT JOIN ok b ON b.employee_id = a.employee_id AND b.rn > a.rn GROUP BY a.employee_id, a.rn, a.dept, a.st""")
def apply_department_change_history(spark, sf):
    """The job history after the moves: rows closed and opened."""
    core, _, _ = _moves(spark, sf)
    return core.history.select("employee_id", "department_id", "effective_start", "effective_end")


# ------------------------------------------------------------------ assignments
ASSIGN_SQL_CTES = f"""
, tbl AS (SELECT * FROM fx_stg_assignment WHERE start_date < DATE '1996-01-01'),
ch0 AS (SELECT seq, employee_id, project_id, allocation_pct FROM fx_stg_assignment
       WHERE start_date >= DATE '1996-01-01' AND seq % 53 <> 0
       UNION ALL SELECT seq, employee_id, project_id + 100000, allocation_pct FROM fx_stg_assignment
       WHERE start_date >= DATE '1996-01-01' AND seq % 53 = 0
       UNION ALL SELECT seq + {BIG}, employee_id, project_id, allocation_pct FROM tbl WHERE seq % 5 = 0),
ch AS (SELECT seq, employee_id, project_id, CASE WHEN seq % 59 = 0 THEN -100 WHEN seq % 61 = 0 THEN 0 WHEN seq % 67 <> 0 THEN allocation_pct END allocation_pct FROM ch0),
chn AS (SELECT c.*, row_number() OVER (PARTITION BY employee_id ORDER BY seq, project_id) rn,
               EXISTS (SELECT 1 FROM fx_employee e WHERE e.employee_id = c.employee_id) has_emp,
               EXISTS (SELECT 1 FROM fx_project p WHERE p.project_id = c.project_id) has_prj,
               EXISTS (SELECT 1 FROM tbl t WHERE t.employee_id = c.employee_id AND t.project_id = c.project_id) has_pair
        FROM ch c),
used0 AS (SELECT employee_id, sum(allocation_pct) u FROM tbl WHERE end_date IS NULL GROUP BY 1),
r AS (
  SELECT e.employee_id, CAST(0 AS BIGINT) rn, CAST(NULL AS BIGINT) seq, CAST(NULL AS BIGINT) project_id,
         CAST(coalesce(u.u, 0) AS BIGINT) used, CAST([] AS BIGINT[]) taken,
         CAST(NULL AS VARCHAR) status, CAST(NULL AS VARCHAR) reason
  FROM (SELECT DISTINCT employee_id FROM ch) e LEFT JOIN used0 u ON u.employee_id = e.employee_id
  UNION ALL
  SELECT x.employee_id, x.rn, x.seq, x.project_id,
         CASE WHEN x.reason IS NULL THEN x.used + x.allocation_pct ELSE x.used END,
         CASE WHEN x.reason IS NULL THEN list_append(x.taken, x.project_id) ELSE x.taken END,
         CASE WHEN x.reason IS NULL THEN 'accepted' ELSE 'rejected' END, x.reason
  FROM (SELECT n.employee_id, n.rn, n.seq, n.project_id, n.allocation_pct, r.used, r.taken,
               CASE WHEN NOT n.has_emp THEN 'no such employee' WHEN NOT n.has_prj THEN 'no such project'
                    WHEN coalesce(n.allocation_pct, 0) < 1 OR n.allocation_pct > 100 THEN 'allocation_pct:range'
                    WHEN n.has_pair THEN 'already assigned to that project'
                    WHEN r.used + n.allocation_pct > 100 THEN 'allocation over 100%'
                    WHEN list_contains(r.taken, n.project_id) THEN 'already assigned to that project'
               END reason
        FROM r JOIN chn n ON n.employee_id = r.employee_id AND n.rn = r.rn + 1) x)"""


def _assign(spark, sf):
    """Assignments from 1996 on (with re-requests of older pairs, unknown
    projects and impossible shares) against the pre-1996 table."""
    f = fx(spark, sf)
    a = materialize(f.stg_assignment())  # the table, its employees' shares and the batch all read it: written once
    cut = F.lit("1996-01-01").cast("date")
    tbl = a.filter(F.col("start_date") < cut)
    later = a.filter(F.col("start_date") >= cut)
    q = F.col("seq")
    batch = (later.withColumn("project_id", F.when(q % 53 == 0, F.col("project_id") + 100000).otherwise(F.col("project_id"))).drop("end_date")
             .unionByName(tbl.filter(q % 5 == 0).withColumn("seq", q + BIG).drop("end_date")))
    share = F.when(q % 59 == 0, -100).when(q % 61 == 0, 0).when(q % 67 != 0, F.col("allocation_pct")).cast("int")
    return CH.apply_assignments(_core(f, assignments=tbl.drop("seq")), batch.withColumn("allocation_pct", share))


@query("apply_assignments", "RECURSIVE" + ASSIGN_SQL_CTES + """
SELECT seq, employee_id, project_id, status, reason FROM r WHERE rn > 0""")
def apply_assignments(spark, sf):
    """Every requested assignment, accepted or rejected."""
    _, acc, rej = _assign(spark, sf)
    cols = ["seq", "employee_id", "project_id", CH.STATUS, CH.REASON]
    return acc.select(*cols).unionByName(rej.select(*cols))


@query("apply_assignments_table", "RECURSIVE" + ASSIGN_SQL_CTES + """
SELECT employee_id, project_id, allocation_pct, start_date FROM tbl
UNION ALL SELECT r.employee_id, r.project_id, c.allocation_pct, s.start_date FROM r
JOIN ch c ON c.employee_id = r.employee_id AND c.project_id = r.project_id AND c.seq = r.seq
JOIN fx_stg_assignment s ON s.employee_id = r.employee_id AND s.project_id = r.project_id AND s.seq = r.seq
WHERE r.status = 'accepted'""")
def apply_assignments_table(spark, sf):
    """The assignment table after the batch."""
    core, _, _ = _assign(spark, sf)
    return core.assignments.select("employee_id", "project_id", "allocation_pct", "start_date")


@query("current_allocation", """
SELECT e.employee_id, CAST(coalesce(sum(a.allocation_pct), 0) AS BIGINT) total
FROM fx_employee e LEFT JOIN fx_stg_assignment a ON a.employee_id = e.employee_id AND a.end_date IS NULL
GROUP BY e.employee_id""")
def current_allocation(spark, sf):
    f = fx(spark, sf)
    return CH.current_allocation(_core(f))
