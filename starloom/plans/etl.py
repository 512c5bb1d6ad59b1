"""Whole-warehouse runs: calendar -> departments -> projects -> employees -> fact."""
from __future__ import annotations

from pyspark.sql import SparkSession

from . import dims, fact as factmod, scd2
from .model import Core, Warehouse


def run_full(spark: SparkSession, core: Core, start=dims.DEFAULT_START, end=dims.DEFAULT_END,
             dw: Warehouse | None = None, keep=None) -> Warehouse:
    """Frames of the next warehouse state.

    Every dimension is handed to ``keep(name, df) -> df`` as soon as it is
    built; the default writes it once to the shared checkpoint folder, a
    publisher passes a function that stages it as the next table version.
    Later steps read the kept table, never its lineage.  The fact stays lazy:
    ``fact`` is its next state, and ``extra["fact_added"]`` the rows this run
    adds, which a publisher appends (``store.stage("fact", added,
    append=True)``) instead of rewriting the table."""
    from ..session import materialize
    keep = keep or (lambda name, d: materialize(d))
    dd = keep("dim_date", dims.dim_date(spark, start, end, dw.dim_date if dw else None))
    cal = dims.calendar_rows(start, end) if dw is None else None
    dep = keep("dim_department", dims.dim_department(core.departments, dw.dim_department if dw else None))
    prj = keep("dim_project", dims.dim_project(core.projects, core.departments, dw.dim_project if dw else None))
    emp = keep("dim_employee", scd2.scd2_refresh(core.history, core.employees, core.departments,
                                                 dw.dim_employee if dw else None, core.job_roles))
    add = factmod.load_fact(core.reviews, emp, dep, dd, prj, dw.fact if dw else None, cal)
    fct = add if dw is None else dw.fact.unionByName(add)
    return Warehouse(dd, dep, prj, emp, fct, {"fact_added": add})


def refresh_reviews(spark: SparkSession, core: Core, dw: Warehouse,
                    start=dims.DEFAULT_START, end=dims.DEFAULT_END) -> Warehouse:
    """Calendar + projects + fact only (employee dimension untouched)."""
    dd = dims.dim_date(spark, start, end, dw.dim_date)
    prj = dims.dim_project(core.projects, core.departments, dw.dim_project)
    add = factmod.load_fact(core.reviews, dw.dim_employee, dw.dim_department, dd, prj, dw.fact)
    return dw.with_(dim_date=dd, dim_project=prj, fact=dw.fact.unionByName(add), extra={"fact_added": add})
