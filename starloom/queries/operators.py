"""Operator-level queries (scalar functions, filters, joins, aggregates,
windows, sort/limit/set operations, keys) over the fixture views."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as FN
from .. import oracle as O
from ..functions.numeric import EDUCATION_LEVELS, RATING_LABELS
from ..operators import aggregates as AG, filters as FL, joins as J, setops as S, windows as W
from ..plans import scd2
from ..registry import query
from ..sources.fixtures import Fixture, fixture_core, fixture_warehouse


def fx(spark, sf) -> Fixture:
    return Fixture(spark, sf)


# ------------------------------------------------------------ 2.B functions
@query("proj_clean_text", """
SELECT employee_id, trim(first_name) first_name, trim(department) department FROM fx_stg_employee_dirty""")
def proj_clean_text(spark, sf):
    s = fx(spark, sf).stg_employee_dirty()
    return s.select("employee_id", FN.clean_text("first_name").alias("first_name"),
                    FN.clean_text("department").alias("department"))


@query("proj_clean_email", "SELECT employee_id, lower(trim(email)) email FROM fx_stg_employee_dirty")
def proj_clean_email(spark, sf):
    s = fx(spark, sf).stg_employee_dirty()
    return s.select("employee_id", FN.clean_email("email").alias("email"))


@query("proj_yes_no_flag", """
SELECT employee_id, CAST(trim(over_time)='Yes' AS INT) over_time, CAST(trim(attrition)='Yes' AS INT) attrition
FROM fx_stg_employee""")
def proj_yes_no_flag(spark, sf):
    s = fx(spark, sf).stg_employee()
    return s.select("employee_id", FN.yes_no("over_time").alias("over_time"), FN.yes_no("attrition").alias("attrition"))


@query("proj_concat_name", "SELECT employee_id, concat(trim(first_name), ' ', trim(last_name)) full_name FROM fx_stg_employee")
def proj_concat_name(spark, sf):
    s = fx(spark, sf).stg_employee()
    return s.select("employee_id", FN.full_name(FN.clean_text("first_name"), FN.clean_text("last_name")).alias("full_name"))


@query("proj_slug", """
SELECT employee_id, concat(regexp_replace(lower(first_name), '[^a-z0-9.]', '', 'g'), '.',
       regexp_replace(lower(last_name), '[^a-z0-9.]', '', 'g'), '.', CAST(employee_id AS VARCHAR), '@corp.example') email
FROM fx_stg_employee""")
def proj_slug(spark, sf):
    s = fx(spark, sf).stg_employee()
    return s.select("employee_id", FN.slug_email("first_name", "last_name", "employee_id").alias("email"))


@query("proj_case_label", """
SELECT employee_id, CASE WHEN over_time=1 THEN 'Overtime' ELSE 'No overtime' END overtime_group,
       CASE WHEN attrition=1 THEN 'Yes' ELSE 'No' END attrition_label FROM fx_employee""")
def proj_case_label(spark, sf):
    e = fx(spark, sf).employee()
    return e.select("employee_id", FN.flag_label("over_time", "Overtime", "No overtime").alias("overtime_group"),
                    FN.flag_label("attrition", "Yes", "No").alias("attrition_label"))


@query("proj_coalesce", "SELECT review_id, CAST(coalesce(project_id, -1) AS BIGINT) project_id FROM fx_review")
def proj_coalesce(spark, sf):
    r = fx(spark, sf).review()
    return r.select("review_id", FN.or_default("project_id", -1).cast("long").alias("project_id"))


@query("proj_round", """
SELECT employee_id, CAST((2*sc + 30) // 60 AS DOUBLE) / 10 third_1dp, CAST((2*sc + 7) // 14 AS DOUBLE) / 100 seventh_2dp
FROM (SELECT employee_id, sum(CAST(round(review_score*100) AS BIGINT)) sc FROM fx_review GROUP BY employee_id) x""")
def proj_round(spark, sf):
    """Half-up rounding on exact decimals (per-employee score totals)."""
    r = fx(spark, sf).review()
    g = r.groupBy("employee_id").agg(F.sum("review_score").cast("decimal(18,2)").alias("s"))
    return g.select("employee_id", FN.round_half_up(F.col("s") / 3, 1).cast("double").alias("third_1dp"),
                    FN.round_half_up(F.col("s") / 7, 2).cast("double").alias("seventh_2dp"))


@query("proj_date_parts", """
SELECT review_id, CAST(year(review_date) AS INT) year_number, CAST(month(review_date) AS INT) month_number,
       CAST(day(review_date) AS INT) day_of_month, CAST(quarter(review_date) AS INT) quarter_number,
       dayname(review_date) day_name, monthname(review_date) month_name,
       CAST(CASE WHEN dayofweek(review_date) IN (0, 6) THEN 1 ELSE 0 END AS INT) is_weekend
FROM fx_review""")
def proj_date_parts(spark, sf):
    r = fx(spark, sf).review().select("review_id", "review_date")
    return FN.with_date_parts(r, "review_date").select(
        "review_id", "year_number", "month_number", "day_of_month", "quarter_number", "day_name", "month_name",
        "is_weekend")


@query("proj_date_key", "SELECT review_id, CAST(year(review_date)*10000+month(review_date)*100+day(review_date) AS INT) date_key FROM fx_review")
def proj_date_key(spark, sf):
    r = fx(spark, sf).review()
    return r.select("review_id", FN.date_key("review_date").alias("date_key"))


@query("proj_date_arith", """
SELECT employee_id, effective_start, CAST(effective_start + INTERVAL 30 DAY AS DATE) plus_30,
       CAST(effective_start - INTERVAL 1 DAY AS DATE) day_before,
       CAST(date_diff('day', DATE '1990-01-01', effective_start) AS INT) days_since_1990
FROM fx_history""")
def proj_date_arith(spark, sf):
    h = fx(spark, sf).history()
    return h.select("employee_id", "effective_start", FN.add_days("effective_start", 30).alias("plus_30"),
                    FN.sub_days("effective_start", 1).alias("day_before"),
                    FN.days_between("effective_start", F.lit("1990-01-01").cast("date")).alias("days_since_1990"))


@query("proj_cast_date_literal", """
SELECT employee_id, effective_start, coalesce(CAST(lead(effective_start) OVER (PARTITION BY employee_id
       ORDER BY effective_start) - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') end_date FROM fx_history""")
def proj_cast_date_literal(spark, sf):
    h = W.with_next(fx(spark, sf).history(), "employee_id", "effective_start", "effective_start", "nxt")
    return h.select("employee_id", "effective_start",
                    F.coalesce(FN.sub_days("nxt", 1), FN.open_end()).alias("end_date"))


@query("proj_bool_arith", """
SELECT review_id, CAST(CAST(job_satisfaction<=2 AS INT)*2 + CAST(work_life_balance<=2 AS INT)
       + CAST(performance_rating<=2 AS INT) AS INT) mood_risk FROM fx_review""")
def proj_bool_arith(spark, sf):
    r = fx(spark, sf).review()
    return r.select("review_id", (FN.as_int(F.col("job_satisfaction") <= 2) * 2 + FN.as_int(F.col("work_life_balance") <= 2)
                                  + FN.as_int(F.col("performance_rating") <= 2)).alias("mood_risk"))


@query("proj_clip", """
SELECT employee_id, CAST(greatest(least(age + 5, 60), 18) AS INT) age_clipped,
       CAST(greatest(least(monthly_income_j, 3500), 3100) AS INT) income_clipped
FROM (SELECT employee_id, age, CAST(3000 + employee_id % 1000 AS INT) monthly_income_j FROM fx_employee) x""")
def proj_clip(spark, sf):
    e = fx(spark, sf).employee().select("employee_id", "age",
                                        (F.lit(3000) + F.col("employee_id") % 1000).cast("int").alias("inc"))
    return e.select("employee_id", FN.clip(F.col("age") + 5, 18, 60).cast("int").alias("age_clipped"),
                    FN.clip("inc", 3100, 3500).cast("int").alias("income_clipped"))


@query("proj_review_score", """
SELECT review_id, CAST(round(CAST(performance_rating AS DECIMAL(18,6)) * 15
       + CAST(job_satisfaction + environment_satisfaction + work_life_balance AS DECIMAL(18,6)) * 10 / 3, 2)
       AS DECIMAL(5,2)) computed_score FROM fx_review""")
def proj_review_score(spark, sf):
    r = fx(spark, sf).review()
    return r.select("review_id", FN.review_score("performance_rating", "job_satisfaction",
                                                 "environment_satisfaction", "work_life_balance").alias("computed_score"))


def _case_sql(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


@query("proj_decode_scale", f"""
SELECT review_id, {_case_sql('performance_rating', RATING_LABELS)} rating_label,
       {_case_sql('1 + review_id % 5', EDUCATION_LEVELS)} education_label FROM fx_review""")
def proj_decode_scale(spark, sf):
    r = fx(spark, sf).review()
    return r.select("review_id", FN.decode("performance_rating", RATING_LABELS).alias("rating_label"),
                    FN.decode((F.lit(1) + F.col("review_id") % 5).cast("int"), EDUCATION_LEVELS).alias("education_label"))


@query("proj_star_alias", """
SELECT h.*, h.effective_start start_date, CAST(h.job_level * 10 AS INT) level_x10 FROM fx_history h""")
def proj_star_alias(spark, sf):
    h = fx(spark, sf).history()
    return h.select("*", F.col("effective_start").alias("start_date"), (F.col("job_level") * 10).alias("level_x10"))


# ------------------------------------------------------------ 2.C filters
@query("filter_eq", "SELECT employee_id, start_date, department_name FROM o_dim_employee WHERE is_current = 1")
def filter_eq(spark, sf):
    d = fixture_warehouse(spark, sf).dim_employee
    return FL.eq(d, "is_current", 1).select("employee_id", "start_date", "department_name")


@query("filter_neq", "SELECT project_id, project_name, status FROM fx_project WHERE status <> 'Completed'")
def filter_neq(spark, sf):
    return FL.neq(fx(spark, sf).project(), "status", "Completed").select("project_id", "project_name", "status")


@query("filter_between", """
SELECT review_id, employee_id, review_date FROM fx_review WHERE review_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""")
def filter_between(spark, sf):
    r = fx(spark, sf).review()
    return FL.between(r, "review_date", F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date")) \
        .select("review_id", "employee_id", "review_date")


@query("filter_in", "SELECT review_id, performance_rating FROM fx_review WHERE performance_rating IN (1, 2)")
def filter_in(spark, sf):
    return FL.is_in(fx(spark, sf).review(), "performance_rating", [1, 2]).select("review_id", "performance_rating")


@query("filter_is_null", """
SELECT employee_id, effective_start FROM (SELECT h.*, lead(effective_start) OVER (PARTITION BY employee_id
  ORDER BY effective_start) nxt FROM fx_history h) x WHERE nxt IS NULL""")
def filter_is_null(spark, sf):
    h = W.with_next(fx(spark, sf).history(), "employee_id", "effective_start", "effective_start", "effective_end")
    return FL.is_open(h, "effective_end").select("employee_id", "effective_start")


@query("filter_optional_param", """
SELECT employee_id, start_date, end_date, department_name FROM o_dim_employee
WHERE employee_id IN (SELECT employee_id FROM fx_employee WHERE over_time = 1)""")
def filter_optional_param(spark, sf):
    """Timeline refreshed for a key set (employees with overtime)."""
    core = fixture_core(spark, sf)
    keys = core.employees.filter(F.col("over_time") == 1).select("employee_id")
    return scd2.timeline(core.history, core.employees, core.departments, keys=keys) \
        .select("employee_id", "start_date", "end_date", "department_name")


@query("filter_having", """
SELECT employee_id, CAST(count(*) AS BIGINT) n FROM fx_review GROUP BY employee_id HAVING count(*) >= 15""")
def filter_having(spark, sf):
    return FL.groups_having(fx(spark, sf).review(), ["employee_id"], 15)


@query("filter_scalar_subquery", """
SELECT review_id, employee_id FROM fx_review
WHERE employee_id = (SELECT min(employee_id) FROM (SELECT employee_id FROM fx_review GROUP BY 1 HAVING count(*) >= 15) x)""")
def filter_scalar_subquery(spark, sf):
    r = fx(spark, sf).review()
    busy = FL.groups_having(r, ["employee_id"], 15).select("employee_id")
    return FL.where_key_is(r, "employee_id", busy).select("review_id", "employee_id")


@query("filter_exists_probe", """
SELECT DISTINCT s.employee_id FROM fx_snapshot_dirty s WHERE EXISTS (SELECT 1 FROM fx_employee e
  WHERE e.employee_id = s.employee_id AND e.attrition = 1)""")
def filter_exists_probe(spark, sf):
    f = fx(spark, sf)
    table = f.employee().filter(F.col("attrition") == 1)
    return FL.existing(f.snapshot_dirty(), table, ["employee_id"]).select("employee_id").distinct()


# ------------------------------------------------------------ 2.D joins
@query("join_inner_lookup", """
SELECT s.employee_id, d.department_id FROM fx_stg_employee s JOIN fx_department d ON d.department_name = trim(s.department)""")
def join_inner_lookup(spark, sf):
    f = fx(spark, sf)
    return J.lookup(f.stg_employee(), f.department(), FN.clean_text("department"), "department_name",
                    ["department_id"]).select("employee_id", "department_id")


@query("join_inner_star", """
SELECT f.review_id, f.department_name, coalesce(p.project_name, 'No project') project_name, d.year_number
FROM o_fact f JOIN o_dim_date d ON d.date_key = f.date_key
LEFT JOIN fx_project p ON p.project_id = f.project_id""")
def join_inner_star(spark, sf):
    dw = fixture_warehouse(spark, sf)
    dep = dw.dim_department.select("department_key", "department_name")
    prj = dw.dim_project.select("project_key", "project_name")
    dt = dw.dim_date.select("date_key", "year_number")
    return J.star(dw.fact, [(dt, "date_key"), (dep, "department_key"), (prj, "project_key")]) \
        .select("review_id", "department_name", "project_name", "year_number")


@query("join_inner_orphan_drop", """
SELECT a.employee_id, a.project_id FROM fx_assignment a WHERE a.project_id IN (SELECT project_id FROM fx_project WHERE status = 'Active')""")
def join_inner_orphan_drop(spark, sf):
    f = fx(spark, sf)
    return J.drop_orphans(f.assignment(), f.project().filter(F.col("status") == "Active"), "project_id") \
        .select("employee_id", "project_id")


@query("join_left_outer", """
SELECT r.review_id, CAST(coalesce(p.project_id, -1) AS BIGINT) open_project
FROM fx_review r LEFT JOIN (SELECT project_id FROM fx_project WHERE status <> 'Completed') p ON p.project_id = r.project_id""")
def join_left_outer(spark, sf):
    f = fx(spark, sf)
    openp = f.project().filter(F.col("status") != "Completed").select("project_id", F.col("project_id").alias("open_project"))
    out = J.lookup_or(f.review().select("review_id", "project_id"), openp, "project_id", "open_project", -1)
    return out.select("review_id", F.col("open_project").cast("long").alias("open_project"))


@query("join_left_anti", """
SELECT e.employee_id FROM fx_employee e WHERE NOT EXISTS (SELECT 1 FROM fx_review r WHERE r.employee_id = e.employee_id
  AND r.review_date >= DATE '2000-01-01')""")
def join_left_anti(spark, sf):
    f = fx(spark, sf)
    recent = f.review().filter(F.col("review_date") >= F.lit("2000-01-01").cast("date"))
    return J.not_in(f.employee(), recent, "employee_id").select("employee_id")


@query("join_left_semi", """
SELECT r.review_id FROM fx_review r WHERE r.employee_id IN (SELECT employee_id FROM fx_employee WHERE over_time = 1)""")
def join_left_semi(spark, sf):
    f = fx(spark, sf)
    return J.only_in(f.review(), f.employee().filter(F.col("over_time") == 1), "employee_id").select("review_id")


@query("join_update", """
SELECT p.project_id, p.project_name,
       CASE WHEN p.status = 'On Hold' THEN 'Active' ELSE p.status END status, p.priority FROM fx_project p""")
def join_update(spark, sf):
    """UPDATE projects JOIN (on-hold projects) SET status = 'Active'."""
    p = fx(spark, sf).project()
    src = p.filter(F.col("status") == "On Hold").select("project_id", F.lit("Active").alias("status"))
    return J.overwrite(p, src, "project_id", ["status"]).select("project_id", "project_name", "status", "priority")


@query("join_point_in_time_first", """
SELECT r.review_id, min_by(a.project_id, a.seq * 1000000 + a.project_id) project_id
FROM fx_review r LEFT JOIN fx_stg_assignment a ON a.employee_id = r.employee_id AND a.start_date <= r.review_date
     AND coalesce(a.end_date, DATE '9999-12-31') >= r.review_date
GROUP BY r.review_id""")
def join_point_in_time_first(spark, sf):
    """First assignment (arrival order) that covers the review date; a
    quarter of the assignments has an end."""
    f = fx(spark, sf)
    r = f.review().select("review_id", "employee_id", "review_date")
    out = J.first_covering(r, f.stg_assignment(), "employee_id", "review_date", "review_id", "seq", "project_id")
    return out.select("review_id", "project_id")


# ------------------------------------------------------------ 2.E aggregates
@query("agg_count_star", "SELECT performance_rating, CAST(count(*) AS BIGINT) n FROM fx_review GROUP BY 1")
def agg_count_star(spark, sf):
    return AG.count_rows(fx(spark, sf).review(), ["performance_rating"])


@query("agg_sum", """
SELECT e.employee_id, CAST(coalesce(sum(a.allocation_pct), 0) AS BIGINT) total
FROM fx_employee e LEFT JOIN fx_assignment a ON a.employee_id = e.employee_id GROUP BY e.employee_id""")
def agg_sum(spark, sf):
    f = fx(spark, sf)
    j = f.employee().select("employee_id").join(f.assignment().select("employee_id", "allocation_pct"), "employee_id", "left")
    return AG.sum_or_zero(j, ["employee_id"], "allocation_pct", "total")


@query("agg_avg", f"""
SELECT employee_id, {O.avg_cents_2dp('sum(CAST(round(review_score*100) AS BIGINT))', 'count(*)')} avg_score
FROM fx_review GROUP BY employee_id""")
def agg_avg(spark, sf):
    return AG.avg_exact(fx(spark, sf).review(), ["employee_id"], "review_score", 2, "avg_score")


@query("agg_avg_predicate", f"""
SELECT work_life_balance, {O.pct_1dp('sum(CAST(performance_rating <= 2 AS INT))', 'count(*)')} low_rating_pct
FROM fx_review GROUP BY 1""")
def agg_avg_predicate(spark, sf):
    return AG.pct_where(fx(spark, sf).review(), ["work_life_balance"], F.col("performance_rating") <= 2, 1,
                        "low_rating_pct")


@query("agg_count_distinct", """
SELECT project_id, CAST(count(DISTINCT employee_id) AS BIGINT) people FROM fx_review WHERE project_id IS NOT NULL GROUP BY 1""")
def agg_count_distinct(spark, sf):
    r = fx(spark, sf).review().filter(F.col("project_id").isNotNull())
    return AG.count_distinct(r, ["project_id"], "employee_id", "people")


@query("agg_count_distinct_approx", """
SELECT project_id, CAST(count(DISTINCT employee_id) AS BIGINT) people, TRUE AS within FROM fx_review WHERE project_id IS NOT NULL GROUP BY 1""")
def agg_count_distinct_approx(spark, sf):
    """Distinct people per project from sketches of each (year, project),
    united at read, beside the exact number: within five standard errors."""
    r = fx(spark, sf).review().filter(F.col("project_id").isNotNull())
    stored = AG.distinct_sketches(r.withColumn("y", F.year("review_date")), ["y", "project_id"], "employee_id", "people")
    guess = AG.distinct_estimate(stored, ["project_id"], "people", "guess")
    both = AG.count_distinct(r, ["project_id"], "employee_id", "people").join(guess, "project_id")
    near = F.abs(F.col("guess") - F.col("people")) <= F.ceil(5 * AG.SKETCH_ERROR * F.col("people"))
    return both.select("project_id", "people", near.alias("within"))


@query("agg_group_multi", """
SELECT performance_rating, job_satisfaction, work_life_balance, CAST(count(*) AS BIGINT) n,
       CAST(sum(percent_salary_hike) AS BIGINT) hike_sum FROM fx_review GROUP BY 1, 2, 3""")
def agg_group_multi(spark, sf):
    return AG.group_agg(fx(spark, sf).review(), ["performance_rating", "job_satisfaction", "work_life_balance"],
                        [F.count(F.lit(1)).alias("n"), F.sum(F.col("percent_salary_hike").cast("bigint")).alias("hike_sum")])


@query("agg_distinct", "SELECT DISTINCT department_id, job_role FROM fx_history")
def agg_distinct(spark, sf):
    return AG.distinct_of(fx(spark, sf).history(), ["department_id", "job_role"])


@query("agg_scalar_bundle", f"""
SELECT CAST((SELECT count(*) FROM fx_employee) AS BIGINT) employees,
       CAST((SELECT count(*) FROM fx_review) AS BIGINT) reviews,
       (SELECT {O.avg_cents_1dp('sum(CAST(round(review_score*100) AS BIGINT))', 'count(*)')} FROM fx_review) avg_score,
       CAST((SELECT count(*) FROM fx_project WHERE status = 'Active') AS BIGINT) active_projects""")
def agg_scalar_bundle(spark, sf):
    f = fx(spark, sf)
    a = f.employee().agg(F.count(F.lit(1)).alias("employees"))
    b = f.review().agg(F.count(F.lit(1)).alias("reviews"), AG.avg_exact_col("review_score", 1).alias("avg_score"))
    c = f.project().filter(F.col("status") == "Active").agg(F.count(F.lit(1)).alias("active_projects"))
    return AG.one_row(a, b, c)


@query("agg_count_groups", """
SELECT CAST(count(*) AS BIGINT) n_groups FROM (SELECT employee_id, review_date FROM fx_review GROUP BY 1, 2 HAVING count(*) > 1) x""")
def agg_count_groups(spark, sf):
    return AG.count_groups(fx(spark, sf).review(), ["employee_id", "review_date"], 1, strict=True)


# ------------------------------------------------------------ 2.G windows
@query("win_row_number_dedup", """
SELECT review_id, employee_id, review_date FROM (SELECT r.*, row_number() OVER (PARTITION BY employee_id, review_date
  ORDER BY review_id) rn FROM fx_review r) x WHERE rn = 1""")
def win_row_number_dedup(spark, sf):
    return W.first_per(fx(spark, sf).review(), ["employee_id", "review_date"], ["review_id"]) \
        .select("review_id", "employee_id", "review_date")


@query("win_row_number_latest", """
SELECT employee_id, review_id, date_key FROM (SELECT f.*, row_number() OVER (PARTITION BY employee_id
  ORDER BY date_key DESC) rn FROM o_fact f) x WHERE rn = 1""")
def win_row_number_latest(spark, sf):
    f = fixture_warehouse(spark, sf).fact
    return W.latest_per(f, "employee_id", "date_key").select("employee_id", "review_id", "date_key")


@query("win_lead", """
SELECT employee_id, effective_start, lead(effective_start) OVER (PARTITION BY employee_id ORDER BY effective_start) next_start
FROM fx_history""")
def win_lead(spark, sf):
    return W.with_next(fx(spark, sf).history(), "employee_id", "effective_start", "effective_start") \
        .select("employee_id", "effective_start", "next_start")


@query("win_lag_delta", """
SELECT employee_id, y, n, n - lag(n) OVER (PARTITION BY employee_id ORDER BY y) delta
FROM (SELECT employee_id, CAST(year(review_date) AS INT) y, CAST(count(*) AS BIGINT) n FROM fx_review GROUP BY 1, 2) x""")
def win_lag_delta(spark, sf):
    r = fx(spark, sf).review()
    g = r.groupBy("employee_id", F.year("review_date").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return W.with_delta(g, "employee_id", "y", "n", 0, "delta").select("employee_id", "y", "n", "delta")


@query("win_dense_rank_topk", """
SELECT employee_id, review_id, review_score, CAST(rk AS INT) rk FROM (SELECT r.*, dense_rank() OVER
  (PARTITION BY employee_id ORDER BY review_score DESC) rk FROM fx_review r) x WHERE rk <= 3""")
def win_dense_rank_topk(spark, sf):
    r = fx(spark, sf).review()
    return W.top_ranks(r, "employee_id", ["review_score"], 3, "rk", descending=True) \
        .select("employee_id", "review_id", "review_score", F.col("rk").cast("int").alias("rk"))


@query("win_rank_global", """
SELECT CAST(rank() OVER (ORDER BY n DESC) AS INT) rk, department_id, n
FROM (SELECT department_id, CAST(count(*) AS BIGINT) n FROM fx_history GROUP BY 1) x""")
def win_rank_global(spark, sf):
    g = fx(spark, sf).history().groupBy("department_id").agg(F.count(F.lit(1)).alias("n"))
    return W.with_rank(g, ["n"], True, "rk").select(F.col("rk").cast("int").alias("rk"), "department_id", "n")


# ------------------------------------------------------------ 2.H sort/limit/set/keys
@query("sort_multi", "SELECT project_id, department_id, priority FROM fx_project ORDER BY department_id, priority DESC, project_id")
def sort_multi(spark, sf):
    p = fx(spark, sf).project()
    return S.order_by(p, "department_id", F.col("priority").desc(), "project_id").select("project_id", "department_id", "priority")


@query("limit_topk", "SELECT review_id, review_score FROM fx_review ORDER BY review_score DESC, review_id LIMIT 10")
def limit_topk(spark, sf):
    r = fx(spark, sf).review()
    return S.top_k(r, [F.col("review_score").desc(), F.col("review_id")], 10).select("review_id", "review_score")


@query("limit_any", """
SELECT employee_id, n FROM (SELECT employee_id, CAST(count(*) AS BIGINT) n FROM fx_history GROUP BY 1 HAVING count(*) > 1) x
ORDER BY employee_id LIMIT 1""")
def limit_any(spark, sf):
    g = FL.groups_having(fx(spark, sf).history(), ["employee_id"], 1, strict=True)
    return S.any_one(g, ["employee_id"]).select("employee_id", "n")


@query("set_union_distinct", """
SELECT trim(job_role) job_role FROM fx_stg_employee UNION SELECT trim(job_role) FROM fx_history
UNION SELECT trim(c_mktsegment) FROM customer""")
def set_union_distinct(spark, sf):
    f = fx(spark, sf)
    c = f._t("customer").select(FN.clean_text("c_mktsegment").alias("job_role"))
    return S.union_distinct(f.stg_employee().select(FN.clean_text("job_role").alias("job_role")),
                            f.history().select(FN.clean_text("job_role").alias("job_role")), c)


@query("set_union_all", "SELECT employee_id, email FROM fx_snapshot_dirty")
def set_union_all(spark, sf):
    e = fx(spark, sf).employee().select("employee_id", "email")
    return S.union_all(e, e.filter(F.col("employee_id") % 500 == 1))


@query("key_surrogate", """
SELECT CAST(row_number() OVER (ORDER BY job_role) AS BIGINT) job_role_id, job_role
FROM (SELECT DISTINCT c_mktsegment job_role FROM customer) x""")
def key_surrogate(spark, sf):
    """AUTO_INCREMENT-style keys for the job roles (distributed numbering)."""
    roles = fx(spark, sf)._t("customer").select(F.col("c_mktsegment").alias("job_role")).distinct()
    return S.assign_keys(roles, None, ["job_role"], "job_role_id")


@query("join_map_lookup", """
SELECT h.employee_id, h.effective_start, d.department_name FROM fx_history h
JOIN fx_department d ON d.department_id = h.department_id""")
def join_map_lookup(spark, sf):
    """Code -> label lookup built from a frame (department id -> name)."""
    f = fx(spark, sf)
    return J.lookup(f.history(), f.department(), "department_id", "department_id", ["department_name"]) \
        .select("employee_id", "effective_start", "department_name")


@query("join_cross_numbers", """
SELECT CAST(n AS BIGINT) n, CAST(lo + CAST(n AS INT) AS DATE) calendar_day
FROM (SELECT min(review_date) lo, max(review_date) hi FROM fx_review) b,
     range(0, (SELECT date_diff('day', min(review_date), max(review_date)) + 1 FROM fx_review)) t(n)""")
def join_cross_numbers(spark, sf):
    """Numbers 0..days-1 (spark.range, not a cross join of digit tables) turned
    into every day between the first and last review."""
    r = fx(spark, sf).review()
    b = r.agg(F.min("review_date").alias("lo"), F.max("review_date").alias("hi")).first()  # one bounds row
    n = (b["hi"] - b["lo"]).days + 1
    return J.numbers(spark, n).select("n", F.date_add(F.lit(b["lo"]), F.col("n").cast("int")).alias("calendar_day"))
