"""DuckDB oracle SQL for the registered queries.

Each statement is self-contained: the fixture views and the expected
warehouse (written as plain SQL, independently of the Spark plans) are
prepended as CTEs.  Averages are computed on integer sums so that the
rounding matches exact-decimal averaging (see SURVEY 5.1).
"""
from __future__ import annotations

FX = {
    "fx_department": """SELECT CAST(n_nationkey+1 AS INT) department_id, n_name department_name FROM nation""",
    "fx_employee": """SELECT c_custkey+1 employee_id, c_name full_name,
       concat(CASE WHEN c_custkey%50=0 THEN upper(c_name) ELSE lower(c_name) END, '@corp.example') email,
       c_mktsegment job_role, CAST(c_nationkey AS INT) home_nation, CAST(18+c_custkey%43 AS INT) age,
       CAST(CASE WHEN c_acctbal<0 THEN 1 ELSE 0 END AS INT) attrition,
       CAST(CASE WHEN c_custkey%3=1 THEN 1 ELSE 0 END AS INT) over_time
FROM customer""",
    "fx_history": """SELECT CAST(x.o_custkey+1 AS BIGINT) employee_id,
       CAST(1+(c.c_nationkey + x.b*(x.o_custkey%3))%25 AS INT) department_id, c.c_mktsegment job_role,
       CAST(1+x.b AS INT) job_level, CAST(3000+(x.o_custkey%1000)+500*x.b AS INT) monthly_income,
       x.d0 effective_start,
       CASE WHEN x.b=0 THEN 'Initial Hire' WHEN x.o_custkey%3=0 THEN 'Promotion' ELSE 'Department Transfer' END change_reason
FROM (SELECT o_custkey, CAST(floor((year(o_orderdate)-1995)/2) AS INT) b, CAST(min(o_orderdate) AS DATE) d0
      FROM orders GROUP BY 1,2) x JOIN customer c ON c.c_custkey=x.o_custkey""",
    "fx_project": """SELECT CAST(s_suppkey+1 AS BIGINT) project_id, s_name project_name, CAST(s_nationkey+1 AS INT) department_id,
       CASE WHEN s_suppkey%10<3 THEN 'Completed' WHEN s_suppkey%10<9 THEN 'Active' ELSE 'On Hold' END status,
       CASE WHEN s_suppkey%3=0 THEN 'Low' WHEN s_suppkey%3=1 THEN 'Medium' ELSE 'High' END priority
FROM supplier""",
    "fx_review": """SELECT o_orderkey review_id, o_custkey+1 employee_id, p.project_id,
       CAST(o_orderdate - INTERVAL 30 DAY AS DATE) review_date,
       least(4, CAST(substr(o_orderpriority,1,1) AS INT)) performance_rating,
       CAST(1+o_orderkey%4 AS INT) job_satisfaction, CAST(1+(o_orderkey+o_custkey)%4 AS INT) environment_satisfaction,
       CAST(1+o_custkey%4 AS INT) work_life_balance, CAST(11+o_orderkey%15 AS INT) percent_salary_hike,
       CAST(CAST(CAST(round(o_totalprice*100) AS BIGINT)%10001 AS DECIMAL(18,2))/100 AS DECIMAL(5,2)) review_score
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey)+1 project_id FROM lineitem GROUP BY 1) p ON p.l_orderkey=o_orderkey""",
    "fx_assignment": """SELECT o_custkey+1 employee_id, l_suppkey+1 project_id, min(l_orderkey) seq,
       CAST(10*(1+min(l_orderkey)%6) AS INT) allocation_pct, CAST(min(l_shipdate) AS DATE) start_date
FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2""",
    "fx_snapshot_dirty": """SELECT e.* FROM fx_employee e UNION ALL SELECT e.* FROM fx_employee e WHERE employee_id%500=1""",
    # staging snapshot with planted dirt (padded names and departments, upper-case emails, duplicates)
    "fx_stg_employee": """SELECT c_custkey+1 employee_id,
       CASE WHEN c_custkey%100=7 THEN concat('  ', c_name, ' ') ELSE c_name END first_name,
       c_mktsegment last_name,
       CASE WHEN c_custkey%50=0 THEN upper(concat(c_name, '@corp.example'))
            ELSE lower(concat(c_name, '@corp.example')) END email,
       CASE WHEN c_custkey%2=0 THEN 'Female' ELSE 'Male' END gender,
       CAST(18+c_custkey%43 AS INT) age,
       CASE WHEN c_acctbal<0 THEN 'Yes' ELSE 'No' END attrition,
       CASE WHEN c_custkey%7=0 THEN 'Travel_Frequently' WHEN c_custkey%7<3 THEN 'Non-Travel' ELSE 'Travel_Rarely' END business_travel,
       concat(CASE WHEN c_custkey%40=3 THEN ' ' ELSE '' END, n_name) department,
       CAST(1+c_custkey%29 AS INT) distance_from_home, CAST(1+c_custkey%5 AS INT) education,
       CASE c_custkey%3 WHEN 0 THEN 'Life Sciences' WHEN 1 THEN 'Medical' ELSE 'Marketing' END education_field,
       CAST(1+c_custkey%5 AS INT) job_level, c_mktsegment job_role,
       CASE c_custkey%3 WHEN 0 THEN 'Single' WHEN 1 THEN 'Married' ELSE 'Divorced' END marital_status,
       CAST(3000+c_custkey%1000 AS INT) monthly_income, CAST(c_custkey%10 AS INT) num_companies_worked,
       CASE WHEN c_custkey%3=1 THEN 'Yes' ELSE 'No' END over_time, CAST(c_custkey%4 AS INT) stock_option_level,
       CAST(c_custkey%40 AS INT) total_working_years, CAST(c_custkey%20 AS INT) years_at_company,
       coalesce(h.hire_date, DATE '1995-01-01') hire_date
FROM customer JOIN nation ON n_nationkey=c_nationkey
LEFT JOIN (SELECT employee_id, min(effective_start) hire_date FROM fx_history GROUP BY 1) h
       ON h.employee_id=c_custkey+1""",
    "fx_stg_employee_dirty": """SELECT * FROM fx_stg_employee
UNION ALL
SELECT employee_id, first_name, last_name, upper(email) email, gender, age, attrition, business_travel, department,
       distance_from_home, education, education_field, job_level, job_role, marital_status, monthly_income,
       num_companies_worked, over_time, stock_option_level, total_working_years, years_at_company,
       CAST(hire_date - INTERVAL 365 DAY AS DATE) hire_date
FROM fx_stg_employee WHERE employee_id%500=1""",
    # entry-form batches with planted invalid values
    "fx_entry_employee": """SELECT employee_id,
       CASE WHEN employee_id%97=5 THEN '   ' ELSE first_name END first_name,
       CASE WHEN employee_id%101=6 THEN repeat('x', 61) ELSE last_name END last_name,
       CASE WHEN employee_id%89=4 THEN replace(email, '.example', '')
            WHEN employee_id%103=8 THEN concat(' ', upper(email), ' ') ELSE email END email,
       gender, CAST(CASE WHEN employee_id%83=2 THEN 17 WHEN employee_id%59=9 THEN NULL ELSE age END AS INT) age, marital_status,
       education education_level, education_field, hire_date, department, job_role,
       CAST(CASE WHEN employee_id%73=3 THEN 6 ELSE job_level END AS INT) job_level,
       CAST(CASE WHEN employee_id%79=1 THEN 0 WHEN employee_id%67=4 THEN NULL ELSE monthly_income END AS INT) monthly_income
FROM fx_stg_employee""",
    "fx_entry_project": """SELECT CAST(s_suppkey+1 AS BIGINT) project_id,
       CASE WHEN s_suppkey%17=3 THEN '  ' ELSE s_name END project_name, CAST(s_nationkey+1 AS INT) department_id,
       CASE WHEN s_suppkey%19=4 THEN 'Paused' WHEN s_suppkey%10<3 THEN 'Completed' WHEN s_suppkey%10<9 THEN 'Active'
            ELSE 'On Hold' END status,
       CASE WHEN s_suppkey%23=5 THEN 'Urgent' WHEN s_suppkey%3=0 THEN 'Low' WHEN s_suppkey%3=1 THEN 'Medium'
            ELSE 'High' END priority,
       CAST(CASE WHEN s_suppkey%13=7 THEN -500 WHEN s_suppkey%29=6 THEN NULL ELSE (s_suppkey%100)*1000 END AS DECIMAL(12,2)) budget,
       CASE WHEN s_suppkey%31=2 THEN NULL ELSE CAST(DATE '1995-01-01' + CAST(s_suppkey%365 AS INT) AS DATE) END start_date,
       CASE WHEN s_suppkey%11=5 THEN CAST(DATE '1995-01-01' + CAST(s_suppkey%365 AS INT) - 10 AS DATE)
            WHEN s_suppkey%2=0 THEN CAST(DATE '1995-01-01' + CAST(s_suppkey%365 AS INT) + 200 AS DATE) END end_date
FROM supplier""",
    "fx_entry_review": """SELECT o_orderkey review_id, o_custkey+1 employee_id, CAST(o_orderdate AS DATE) review_date,
       CASE WHEN o_orderkey%53<>1 THEN CAST(substr(o_orderpriority,1,1) AS INT) END performance_rating,
       CASE WHEN o_orderkey%71<>3 THEN CAST(1+o_orderkey%4 AS INT) END job_satisfaction,
       CAST(CASE WHEN o_orderkey%61=0 THEN 0 ELSE 1+(o_orderkey+o_custkey)%4 END AS INT) environment_satisfaction,
       CAST(1+o_custkey%4 AS INT) work_life_balance,
       CAST(CASE WHEN o_orderkey%101=0 THEN 55 ELSE 11+o_orderkey%15 END AS INT) percent_salary_hike
FROM orders""",
    # staging tables (the snapshot is fx_stg_employee_dirty)
    "fx_stg_history": """SELECT h.employee_id,
       concat(CASE WHEN h.employee_id%40=4 THEN ' ' ELSE '' END, d.department_name) department, h.job_role,
       h.job_level, h.monthly_income, h.effective_start, CAST(NULL AS DATE) effective_end, h.change_reason
FROM fx_history h JOIN fx_department d ON d.department_id=h.department_id""",
    "fx_stg_project": """SELECT p.project_id, p.project_name, d.department_name department, p.status, p.priority,
       CAST((p.project_id%100)*1000 AS DECIMAL(12,2)) budget,
       CAST(DATE '1995-01-01' + CAST(p.project_id%365 AS INT) AS DATE) start_date, CAST(NULL AS DATE) end_date
FROM fx_project p JOIN fx_department d ON d.department_id=p.department_id""",
    "fx_stg_assignment": """SELECT employee_id, project_id,
       CASE WHEN seq%3=0 THEN 'Contributor' WHEN seq%3=1 THEN 'Lead' ELSE 'Reviewer' END role_on_project,
       allocation_pct, start_date, CASE WHEN seq%4=0 THEN CAST(start_date + 90 AS DATE) END end_date, seq
FROM fx_assignment""",
    # expected warehouse, business keys only
    "o_dim_employee": """SELECT t.employee_id, t.effective_start start_date,
       coalesce(CAST(t.next_start - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') end_date,
       CAST(CASE WHEN t.next_start IS NULL THEN 1 ELSE 0 END AS INT) is_current,
       e.full_name, e.age, e.attrition attrition_flag, e.over_time over_time_flag,
       d.department_name, t.job_role, t.job_level, t.monthly_income, t.change_reason
FROM (SELECT h.*, lead(effective_start) OVER (PARTITION BY employee_id ORDER BY effective_start) next_start
      FROM fx_history h) t
JOIN fx_department d ON d.department_id=t.department_id
JOIN fx_employee e ON e.employee_id=t.employee_id""",
    "o_dim_date": """SELECT CAST(year(d)*10000+month(d)*100+day(d) AS INT) date_key, d full_date,
       CAST(day(d) AS INT) day_of_month, dayname(d) day_name, CAST(month(d) AS INT) month_number,
       monthname(d) month_name, CAST(quarter(d) AS INT) quarter_number, CAST(year(d) AS INT) year_number,
       CAST(CASE WHEN dayofweek(d) IN (0,6) THEN 1 ELSE 0 END AS INT) is_weekend
FROM (SELECT CAST(x AS DATE) d FROM range(DATE '1994-01-01', DATE '2003-01-01', INTERVAL 1 DAY) t(x))""",
    "o_fact": """SELECT r.review_id, r.employee_id, v.start_date, v.department_name,
       CAST(coalesce(p.project_id,-1) AS BIGINT) project_id,
       CAST(year(r.review_date)*10000+month(r.review_date)*100+day(r.review_date) AS INT) date_key,
       CAST(year(r.review_date) AS INT) review_year,
       r.performance_rating, r.job_satisfaction, r.environment_satisfaction, r.work_life_balance,
       r.percent_salary_hike, r.review_score, CAST(round(r.review_score*100) AS BIGINT) score_cents
FROM (SELECT *, row_number() OVER (PARTITION BY employee_id, review_date ORDER BY review_id) rn FROM fx_review) r
JOIN o_dim_employee v ON v.employee_id=r.employee_id AND r.review_date BETWEEN v.start_date AND v.end_date
JOIN o_dim_date dt ON dt.full_date=r.review_date
LEFT JOIN fx_project p ON p.project_id=r.project_id WHERE r.rn=1""",
    "o_dim_project": """SELECT project_id, project_name, d.department_name, status, priority
FROM fx_project p JOIN fx_department d ON d.department_id=p.department_id
UNION ALL SELECT 0, 'No project', NULL, 'n/a', NULL""",
}


def with_fx(body: str) -> str:
    """Prepend the fixture CTEs; a body starting with ',' adds its own CTEs
    (a body starting with 'RECURSIVE ,' makes the list recursive)."""
    ctes = ",\n".join(f"{k} AS (\n{v}\n)" for k, v in FX.items())
    b = body.lstrip()
    head = "WITH"
    if b.startswith("RECURSIVE"):
        head, b = "WITH RECURSIVE", b[len("RECURSIVE"):].lstrip()
    return f"{head} {ctes}{b}" if b.startswith(",") else f"{head} {ctes}\n{b}"


# -- integer-exact rounding recipes (n = row count, s = integer sum) ----------
def avg_cents_2dp(cents_sum: str, n: str) -> str:
    """round(avg(decimal(5,2)), 2): Spark averages to 6 decimals, then rounds."""
    u = f"((2*CAST({cents_sum} AS HUGEINT)*10000 + {n}) // (2*{n}))"
    return f"(CAST(({u} + 5000) // 10000 AS DOUBLE) / 100)"


def avg_cents_micro(cents_sum: str, n: str) -> str:
    return f"((2*CAST({cents_sum} AS HUGEINT)*10000 + {n}) // (2*{n}))"


def avg_cents_1dp(cents_sum: str, n: str) -> str:
    u = avg_cents_micro(cents_sum, n)
    return f"(CAST(({u} + 50000) // 100000 AS DOUBLE) / 10)"


def avg_int_2dp(int_sum: str, n: str) -> str:
    """round(avg(int as decimal), 2): Spark averages to 4 decimals, then rounds."""
    u4 = f"((2*CAST({int_sum} AS HUGEINT)*10000 + {n}) // (2*{n}))"
    return f"(CAST(({u4} + 50) // 100 AS DOUBLE) / 100)"


def pct_1dp(count_true: str, n: str) -> str:
    """round(100*avg(pred as decimal), 1)."""
    u4 = f"((2*CAST({count_true} AS HUGEINT)*10000 + {n}) // (2*{n}))"
    return f"(CAST(({u4} + 5) // 10 AS DOUBLE) / 10)"


def delta_micro_2dp(du: str) -> str:
    return f"(sign({du}) * CAST((abs({du}) + 5000) // 10000 AS DOUBLE) / 100)"


SQL: dict[str, str] = {}


def register(name: str, body: str) -> None:
    SQL[name] = with_fx(body)
