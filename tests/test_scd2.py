"""SCD2 invariants, rerun safety and incremental behaviour."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from starloom.plans import fact as factmod, scd2
from starloom.sources.fixtures import fixture_core, fixture_warehouse


def test_one_current_row_and_contiguous_intervals(spark):
    dw = fixture_warehouse(spark, SF_SMALL)
    d = dw.dim_employee
    assert d.groupBy("employee_id").agg(F.sum("is_current").alias("c")).filter("c <> 1").count() == 0
    w = Window.partitionBy("employee_id").orderBy("start_date")
    gaps = d.withColumn("nxt", F.lead("start_date").over(w)) \
        .filter(F.col("nxt").isNotNull() & (F.date_add("end_date", 1) != F.col("nxt")))
    assert gaps.count() == 0
    assert d.filter((F.col("is_current") == 1) & (F.col("end_date") != F.lit("9999-12-31").cast("date"))).count() == 0


def test_every_fact_date_within_its_version(spark):
    dw = fixture_warehouse(spark, SF_SMALL)
    f = dw.fact.join(dw.dim_employee.select("employee_key", "start_date", "end_date"), "employee_key")
    day = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
    assert f.filter(~day.between(F.col("start_date"), F.col("end_date"))).count() == 0


def test_rerun_adds_nothing_even_with_duplicate_days(spark):
    core = fixture_core(spark, SF_SMALL)
    assert core.reviews.groupBy("employee_id", "review_date").count().filter("count > 1").count() > 0
    dw = fixture_warehouse(spark, SF_SMALL)
    again = factmod.load_fact(core.reviews, dw.dim_employee, dw.dim_department, dw.dim_date, dw.dim_project,
                              fact=dw.fact)
    assert again.count() == 0


def test_refresh_is_stable_and_per_key_refresh_touches_only_its_key(spark):
    core = fixture_core(spark, SF_SMALL)
    dim = scd2.scd2_refresh(core.history, core.employees, core.departments)
    again = scd2.scd2_refresh(core.history, core.employees, core.departments, existing=dim)
    cols = dim.columns
    assert again.select(*cols).exceptAll(dim.select(*cols)).count() == 0
    # change ages of everyone, refresh only employee 2: only its rows change
    emp2 = core.employees.withColumn("age", F.col("age") + 1)
    one = scd2.scd2_refresh(core.history, emp2, core.departments, existing=dim, keys=2)
    diff = one.select(*cols).exceptAll(dim.select(*cols))
    assert diff.count() > 0 and diff.filter("employee_id <> 2").count() == 0
    # keys never change on refresh
    assert one.join(dim.select("employee_key", "employee_id", "start_date"),
                    ["employee_key", "employee_id", "start_date"]).count() == dim.count()


def test_incremental_equals_full_for_append_only_input(spark):
    core = fixture_core(spark, SF_SMALL)
    dw = fixture_warehouse(spark, SF_SMALL)
    args = (dw.dim_employee, dw.dim_department, dw.dim_date, dw.dim_project)
    cut = F.lit("1998-01-01").cast("date")
    first = factmod.load_fact(core.reviews.filter(F.col("review_date") < cut), *args)
    second = factmod.load_fact(core.reviews, *args, fact=first)
    inc = first.unionByName(second)
    assert inc.exceptAll(dw.fact).count() == 0 and dw.fact.exceptAll(inc).count() == 0


def test_asof_window_equals_interval_join(spark):
    from starloom.operators.joins import asof, asof_window
    core = fixture_core(spark, SF_SMALL)
    v = scd2.timeline(core.history, core.employees, core.departments) \
        .select("employee_id", "start_date", "end_date", "department_name")
    r = core.reviews.select("review_id", "employee_id", "review_date")
    a = asof(r, v, "employee_id", "review_date").select("review_id", "start_date")
    b = asof_window(r, v, "employee_id", "review_date").select("review_id", "start_date")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
