"""Declared schemas of the staging extracts (never inferred)."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

I, L, S, D = T.IntegerType(), T.LongType(), T.StringType(), T.DateType()


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STAGING = {
    "stg_employee_snapshot": _s(
        ("employee_id", I), ("first_name", S), ("last_name", S), ("email", S), ("hire_date", D), ("age", I),
        ("attrition", S), ("business_travel", S), ("department", S), ("distance_from_home", I), ("education", I),
        ("education_field", S), ("gender", S), ("job_level", I), ("job_role", S), ("marital_status", S),
        ("monthly_income", I), ("num_companies_worked", I), ("over_time", S), ("stock_option_level", I),
        ("total_working_years", I), ("years_at_company", I)),
    "stg_employee_history": _s(
        ("employee_id", I), ("department", S), ("job_role", S), ("job_level", I), ("monthly_income", I),
        ("effective_start", D), ("effective_end", D), ("change_reason", S)),
    "stg_projects": _s(
        ("project_id", I), ("project_name", S), ("department", S), ("status", S), ("priority", S),
        ("budget", T.DecimalType(12, 2)), ("start_date", D), ("end_date", D)),
    "stg_assignments": _s(
        ("employee_id", I), ("project_id", I), ("role_on_project", S), ("allocation_pct", I), ("start_date", D),
        ("end_date", D)),
    "stg_reviews": _s(
        ("review_id", I), ("employee_id", I), ("project_id", I), ("review_date", D), ("performance_rating", I),
        ("job_satisfaction", I), ("environment_satisfaction", I), ("work_life_balance", I),
        ("percent_salary_hike", I), ("review_score", T.DecimalType(5, 2))),
}

# The 22 columns a base HR extract must carry.
REQUIRED_BASE_COLUMNS = [
    "Age", "Attrition", "BusinessTravel", "Department", "DistanceFromHome", "Education", "EducationField",
    "EnvironmentSatisfaction", "Gender", "JobLevel", "JobRole", "JobSatisfaction", "MaritalStatus",
    "MonthlyIncome", "NumCompaniesWorked", "OverTime", "PercentSalaryHike", "PerformanceRating",
    "StockOptionLevel", "TotalWorkingYears", "WorkLifeBalance", "YearsAtCompany"]


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField("_corrupt", S, True)])


# -- declared constraints ------------------------------------------------------
@dataclass(frozen=True)
class Rules:
    """Constraints of one table.  ``foreign``: (column, parent table, parent
    column); ``checks``: (name, column, condition), where NULL passes."""
    not_null: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[tuple[str, str, str], ...] = ()
    checks: tuple[tuple[str, str, str], ...] = ()


# The constraints of the conformed tables ...
CORE_RULES = {
    "departments": Rules(("department_id", "department_name"), (("department_name",),)),
    "job_roles": Rules(("job_role_id", "job_title"), (("job_title",),)),
    "employees": Rules(
        ("employee_id", "first_name", "last_name", "email", "gender", "age", "marital_status", "education_level",
         "education_field", "hire_date", "distance_from_home", "business_travel", "over_time", "stock_option_level",
         "total_working_years", "num_companies_worked", "attrition", "department_id", "job_role_id", "job_level",
         "monthly_income"),
        (("email",),),
        (("department_id", "departments", "department_id"), ("job_role_id", "job_roles", "job_role_id")),
        (("age_18_70", "age", "age BETWEEN 18 AND 70"), ("income_positive", "monthly_income", "monthly_income > 0"))),
    "employee_job_history": Rules(
        ("employee_id", "department_id", "job_role_id", "job_level", "monthly_income", "effective_start", "change_reason"),
        (("employee_id", "effective_start"),),
        (("employee_id", "employees", "employee_id"), ("department_id", "departments", "department_id"),
         ("job_role_id", "job_roles", "job_role_id"))),
    "projects": Rules(
        ("project_id", "project_name", "department_id", "status", "priority", "budget", "start_date"),
        (("project_name",),), (("department_id", "departments", "department_id"),)),
    "project_assignments": Rules(
        ("employee_id", "project_id", "role_on_project", "allocation_pct", "start_date"),
        (("employee_id", "project_id"),),
        (("employee_id", "employees", "employee_id"), ("project_id", "projects", "project_id")),
        (("allocation_1_100", "allocation_pct", "allocation_pct BETWEEN 1 AND 100"),)),
    "performance_reviews": Rules(
        ("review_id", "employee_id", "review_date", "performance_rating", "job_satisfaction", "environment_satisfaction",
         "work_life_balance", "percent_salary_hike", "review_score"),
        (("employee_id", "review_date"),),
        (("employee_id", "employees", "employee_id"), ("project_id", "projects", "project_id")),
        (("rating_1_4", "performance_rating", "performance_rating BETWEEN 1 AND 4"),)),
}

# ... and of the warehouse.
WAREHOUSE_RULES = {
    "dim_date": Rules(("date_key", "full_date", "day_of_month", "day_name", "month_number", "month_name", "quarter_number",
                       "year_number", "is_weekend"), (("full_date",),)),
    "dim_department": Rules(("department_key", "department_id", "department_name"), (("department_id",), ("department_name",))),
    "dim_project": Rules(("project_key", "project_id", "project_name"), (("project_id",),)),
    "dim_employee": Rules(
        ("employee_key", "employee_id", "full_name", "gender", "age", "marital_status", "education_level", "education_field",
         "hire_date", "department_name", "job_role", "job_level", "monthly_income", "attrition_flag", "over_time_flag",
         "start_date", "end_date", "is_current"),
        (("employee_id", "start_date"), ("employee_key",))),
    "fact_performance_reviews": Rules(
        ("review_id", "employee_key", "department_key", "project_key", "date_key", "performance_rating", "job_satisfaction",
         "environment_satisfaction", "work_life_balance", "percent_salary_hike", "review_score"),
        (("review_id",),),
        (("employee_key", "dim_employee", "employee_key"), ("department_key", "dim_department", "department_key"),
         ("project_key", "dim_project", "project_key"), ("date_key", "dim_date", "date_key"))),
}

# Column defaults of the conformed tables.
DEFAULTS = {
    "employees": {"distance_from_home": 1, "business_travel": "Non-Travel", "over_time": 0, "stock_option_level": 0,
                  "total_working_years": 0, "num_companies_worked": 0, "attrition": 0},
    "projects": {"status": "Active", "priority": "Medium", "budget": 0},
    "project_assignments": {"role_on_project": "Contributor"},
    "performance_reviews": {"percent_salary_hike": 0},
}
