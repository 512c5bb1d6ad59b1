"""Views that give the test tables the shapes of the HR warehouse.

The mapping (which test column plays which HR column) is fixed by the test
plan; every view is a lazy DataFrame over the parquet tables, so its work
grows with the scale factor and Catalyst prunes the columns that are read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .testdata import table


def _as_date(c: Column) -> Column:
    return c.cast("date")


@dataclass
class Fixture:
    spark: SparkSession
    sf_dir: str

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    # -- departments: one per nation --------------------------------------
    def department(self) -> DataFrame:
        n = self._t("nation")
        return n.select((F.col("n_nationkey") + 1).cast("int").alias("department_id"),
                        F.col("n_name").alias("department_name"))

    # -- employees: one per customer ----------------------------------------
    def employee(self) -> DataFrame:
        c = self._t("customer")
        k = F.col("c_custkey")
        email_user = F.when(k % 50 == 0, F.upper("c_name")).otherwise(F.lower("c_name"))
        return c.select(
            (k + 1).alias("employee_id"),
            F.col("c_name").alias("full_name"),
            F.concat(email_user, F.lit("@corp.example")).alias("email"),
            F.col("c_mktsegment").alias("job_role"),
            F.col("c_nationkey").cast("int").alias("home_nation"),
            (F.lit(18) + k % 43).cast("int").alias("age"),
            F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("int").alias("attrition"),
            F.when(k % 3 == 1, 1).otherwise(0).cast("int").alias("over_time"),
        )

    # -- job history: one version per employee and two-year bucket ----------
    def history(self) -> DataFrame:
        o = self._t("orders")
        bucket = F.floor((F.year("o_orderdate") - 1995) / 2).cast("int")
        x = (o.groupBy("o_custkey", bucket.alias("b"))
             .agg(_as_date(F.min("o_orderdate")).alias("d0")))
        c = self._t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        j = x.join(c, x.o_custkey == c.c_custkey, "inner")
        ck, b = F.col("o_custkey"), F.col("b")
        return j.select(
            (ck + 1).cast("bigint").alias("employee_id"),
            (F.lit(1) + (F.col("c_nationkey") + b * (ck % 3)) % 25).cast("int").alias("department_id"),
            F.col("c_mktsegment").alias("job_role"),
            (F.lit(1) + b).cast("int").alias("job_level"),
            (F.lit(3000) + ck % 1000 + F.lit(500) * b).cast("int").alias("monthly_income"),
            F.col("d0").alias("effective_start"),
            F.when(b == 0, "Initial Hire").when(ck % 3 == 0, "Promotion")
             .otherwise("Department Transfer").alias("change_reason"),
        )

    # -- projects: one per supplier ------------------------------------------
    def project(self) -> DataFrame:
        s = self._t("supplier")
        k = F.col("s_suppkey")
        return s.select(
            (k + 1).cast("bigint").alias("project_id"),
            F.col("s_name").alias("project_name"),
            (F.col("s_nationkey") + 1).cast("int").alias("department_id"),
            F.when(k % 10 < 3, "Completed").when(k % 10 < 9, "Active").otherwise("On Hold").alias("status"),
            F.when(k % 3 == 0, "Low").when(k % 3 == 1, "Medium").otherwise("High").alias("priority"),
        )

    # -- reviews: one per order, dated 30 days before it ---------------------
    def review(self) -> DataFrame:
        o = self._t("orders")
        li = self._t("lineitem")
        p = li.groupBy("l_orderkey").agg((F.min("l_suppkey") + 1).alias("project_id"))
        j = o.join(p, o.o_orderkey == p.l_orderkey, "left")
        ok, ck = F.col("o_orderkey"), F.col("o_custkey")
        score = F.expr("CAST(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 10001 AS DECIMAL(18,2)) / 100"
                       " AS DECIMAL(5,2))")
        return j.select(
            ok.alias("review_id"),
            (ck + 1).alias("employee_id"),
            F.col("project_id"),
            F.date_sub(_as_date(F.col("o_orderdate")), 30).alias("review_date"),
            F.least(F.lit(4), F.substring("o_orderpriority", 1, 1).cast("int")).alias("performance_rating"),
            (F.lit(1) + ok % 4).cast("int").alias("job_satisfaction"),
            (F.lit(1) + (ok + ck) % 4).cast("int").alias("environment_satisfaction"),
            (F.lit(1) + ck % 4).cast("int").alias("work_life_balance"),
            (F.lit(11) + ok % 15).cast("int").alias("percent_salary_hike"),
            score.alias("review_score"),
        )

    # -- assignments: one per (employee, project) pair ------------------------
    def assignment(self) -> DataFrame:
        li = self._t("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
        o = self._t("orders").select("o_orderkey", "o_custkey")
        j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
        g = (j.groupBy((F.col("o_custkey") + 1).alias("employee_id"),
                       (F.col("l_suppkey") + 1).alias("project_id"))
             .agg(F.min("l_orderkey").alias("seq"), F.min("l_shipdate").alias("first_ship")))
        return g.select(
            "employee_id", "project_id", "seq",
            (F.lit(10) * (F.lit(1) + F.col("seq") % 6)).cast("int").alias("allocation_pct"),
            _as_date(F.col("first_ship")).alias("start_date"),
        )

    # -- employee snapshot with planted duplicates ---------------------------
    def snapshot_dirty(self) -> DataFrame:
        e = self.employee()
        return e.unionByName(e.filter(F.col("employee_id") % 500 == 1))


    # -- staging snapshot with planted dirt ----------------------------------
    def stg_employee(self) -> DataFrame:
        c = self._t("customer")
        n = self._t("nation").select("n_nationkey", "n_name")
        k = F.col("c_custkey")
        h = self.history().groupBy("employee_id").agg(F.min("effective_start").alias("hire_date"))
        j = c.join(n, c.c_nationkey == n.n_nationkey, "inner")
        j = j.join(h, (k + 1) == h.employee_id, "left")
        mail = F.concat(F.col("c_name"), F.lit("@corp.example"))
        return j.select(
            (k + 1).alias("employee_id"),
            F.when(k % 100 == 7, F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).otherwise(F.col("c_name"))
             .alias("first_name"),
            F.col("c_mktsegment").alias("last_name"),
            F.when(k % 50 == 0, F.upper(mail)).otherwise(F.lower(mail)).alias("email"),
            F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
            (F.lit(18) + k % 43).cast("int").alias("age"),
            F.when(F.col("c_acctbal") < 0, "Yes").otherwise("No").alias("attrition"),
            F.when(k % 7 == 0, "Travel_Frequently").when(k % 7 < 3, "Non-Travel").otherwise("Travel_Rarely")
             .alias("business_travel"),
            F.concat(F.when(k % 40 == 3, " ").otherwise(""), F.col("n_name")).alias("department"),
            (F.lit(1) + k % 29).cast("int").alias("distance_from_home"),
            (F.lit(1) + k % 5).cast("int").alias("education"),
            F.when(k % 3 == 0, "Life Sciences").when(k % 3 == 1, "Medical").otherwise("Marketing")
             .alias("education_field"),
            (F.lit(1) + k % 5).cast("int").alias("job_level"),
            F.col("c_mktsegment").alias("job_role"),
            F.when(k % 3 == 0, "Single").when(k % 3 == 1, "Married").otherwise("Divorced").alias("marital_status"),
            (F.lit(3000) + k % 1000).cast("int").alias("monthly_income"),
            (k % 10).cast("int").alias("num_companies_worked"),
            F.when(k % 3 == 1, "Yes").otherwise("No").alias("over_time"),
            (k % 4).cast("int").alias("stock_option_level"),
            (k % 40).cast("int").alias("total_working_years"),
            (k % 20).cast("int").alias("years_at_company"),
            F.coalesce("hire_date", F.lit("1995-01-01").cast("date")).alias("hire_date"),
        )

    def stg_employee_dirty(self) -> DataFrame:
        s = self.stg_employee()
        dup = s.filter(F.col("employee_id") % 500 == 1) \
            .withColumn("email", F.upper("email")) \
            .withColumn("hire_date", F.date_sub("hire_date", 365))
        return s.unionByName(dup)


    # -- entry-form batches with planted invalid values -----------------------
    def entry_employee(self) -> DataFrame:
        s = self.stg_employee()
        k = F.col("employee_id")
        return s.select(
            "employee_id",
            F.when(k % 97 == 5, F.lit("   ")).otherwise(F.col("first_name")).alias("first_name"),
            F.when(k % 101 == 6, F.repeat(F.lit("x"), 61)).otherwise(F.col("last_name")).alias("last_name"),
            F.when(k % 89 == 4, F.replace(F.col("email"), F.lit(".example"), F.lit("")))
             .when(k % 103 == 8, F.concat(F.lit(" "), F.upper("email"), F.lit(" ")))
             .otherwise(F.col("email")).alias("email"),
            "gender", F.when(k % 83 == 2, F.lit(17)).when(k % 59 != 9, F.col("age")).cast("int").alias("age"),
            "marital_status", F.col("education").alias("education_level"), "education_field", "hire_date",
            "department", "job_role",
            F.when(k % 73 == 3, F.lit(6)).otherwise(F.col("job_level")).cast("int").alias("job_level"),
            F.when(k % 79 == 1, F.lit(0)).when(k % 67 != 4, F.col("monthly_income")).cast("int").alias("monthly_income"))

    def entry_project(self) -> DataFrame:
        s = self._t("supplier")
        k = F.col("s_suppkey")
        start = F.date_add(F.lit("1995-01-01").cast("date"), (k % 365).cast("int"))
        return s.select(
            (k + 1).cast("bigint").alias("project_id"),
            F.when(k % 17 == 3, F.lit("  ")).otherwise(F.col("s_name")).alias("project_name"),
            (F.col("s_nationkey") + 1).cast("int").alias("department_id"),
            F.when(k % 19 == 4, "Paused").when(k % 10 < 3, "Completed").when(k % 10 < 9, "Active")
             .otherwise("On Hold").alias("status"),
            F.when(k % 23 == 5, "Urgent").when(k % 3 == 0, "Low").when(k % 3 == 1, "Medium")
             .otherwise("High").alias("priority"),
            F.when(k % 13 == 7, F.lit(-500)).when(k % 29 != 6, (k % 100) * 1000).cast("decimal(12,2)").alias("budget"),
            F.when(k % 31 != 2, start).alias("start_date"),
            F.when(k % 11 == 5, F.date_sub(start, 10)).when(k % 2 == 0, F.date_add(start, 200)).alias("end_date"))

    def entry_review(self) -> DataFrame:
        o = self._t("orders")
        ok, ck = F.col("o_orderkey"), F.col("o_custkey")
        return o.select(
            ok.alias("review_id"), (ck + 1).alias("employee_id"), _as_date(F.col("o_orderdate")).alias("review_date"),
            F.when(ok % 53 != 1, F.substring("o_orderpriority", 1, 1).cast("int")).alias("performance_rating"),
            F.when(ok % 71 != 3, F.lit(1) + ok % 4).cast("int").alias("job_satisfaction"),
            F.when(ok % 61 == 0, F.lit(0)).otherwise(F.lit(1) + (ok + ck) % 4).cast("int")
             .alias("environment_satisfaction"),
            (F.lit(1) + ck % 4).cast("int").alias("work_life_balance"),
            F.when(ok % 101 == 0, F.lit(55)).otherwise(F.lit(11) + ok % 15).cast("int").alias("percent_salary_hike"))


    # -- staging tables --------------------------------------------------------
    def stg_history(self) -> DataFrame:
        h = self.history()
        d = self.department()
        j = h.join(d, "department_id", "inner")
        return j.select(
            "employee_id",
            F.concat(F.when(F.col("employee_id") % 40 == 4, " ").otherwise(""), F.col("department_name"))
             .alias("department"),
            "job_role", "job_level", "monthly_income", "effective_start",
            F.lit(None).cast("date").alias("effective_end"), "change_reason")

    def stg_project(self) -> DataFrame:
        p = self.project()
        d = self.department()
        k = F.col("project_id")
        return p.join(d, "department_id", "inner").select(
            "project_id", "project_name", F.col("department_name").alias("department"), "status", "priority",
            ((k % 100) * 1000).cast("decimal(12,2)").alias("budget"),
            F.date_add(F.lit("1995-01-01").cast("date"), (k % 365).cast("int")).alias("start_date"),
            F.lit(None).cast("date").alias("end_date"))

    def stg_assignment(self) -> DataFrame:
        a = self.assignment()
        q = F.col("seq")
        return a.select(
            "employee_id", "project_id",
            F.when(q % 3 == 0, "Contributor").when(q % 3 == 1, "Lead").otherwise("Reviewer").alias("role_on_project"),
            "allocation_pct", "start_date",
            F.when(q % 4 == 0, F.date_add("start_date", 90)).alias("end_date"), "seq")

    def staging(self):
        from ..plans.core_load import Staging
        return Staging(snapshot=self.stg_employee_dirty(), history=self.stg_history(), projects=self.stg_project(),
                       assignments=self.stg_assignment(), reviews=self.review())


# The calendar range that covers every fixture review date.
FIXTURE_START = "1994-01-01"
FIXTURE_END = "2002-12-31"


def fixture_core(spark: SparkSession, sf_dir: str):
    """The fixture views as a conformed core (see plans.model.Core)."""
    from ..plans.model import Core
    fx = Fixture(spark, sf_dir)
    return Core(departments=fx.department(), employees=fx.employee(), history=fx.history(),
                projects=fx.project(), reviews=fx.review(), assignments=fx.assignment())


def fixture_warehouse(spark: SparkSession, sf_dir: str):
    """First full warehouse build over the fixture core (lazy)."""
    from ..plans.etl import run_full
    return run_full(spark, fixture_core(spark, sf_dir), FIXTURE_START, FIXTURE_END)
