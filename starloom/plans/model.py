"""The two table sets the plans pass around."""
from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass
class Core:
    """Conformed (normalised) tables."""
    departments: DataFrame                 # department_id, department_name
    employees: DataFrame                   # employee_id, full_name, email, age, attrition, over_time, ...
    history: DataFrame                     # employee_id, department_id, job_role|job_role_id, job_level,
                                           # monthly_income, effective_start, [effective_end], change_reason
    projects: DataFrame                    # project_id, project_name, department_id, status, priority, ...
    reviews: DataFrame                     # review_id, employee_id, project_id, review_date, scores
    assignments: DataFrame | None = None   # employee_id, project_id, allocation_pct, start_date, [end_date]
    job_roles: DataFrame | None = None     # job_role_id, job_title

    def with_(self, **kw) -> "Core":
        return replace(self, **kw)


@dataclass
class Warehouse:
    """Star schema."""
    dim_date: DataFrame
    dim_department: DataFrame
    dim_project: DataFrame
    dim_employee: DataFrame
    fact: DataFrame
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "Warehouse":
        return replace(self, **kw)
