"""Group states stored beside the warehouse tables.

A state is a row of counts and sums per group, so states of any parts of a
table add up to the state of the table.  They are staged with the part they
describe and become visible in the same commit:

* ``fact_state``: reviews, score in cents and rating per (year, department)
  of each fact part;
* ``dim_employee_state``: current people, leavers and people with a history
  per (bucket, department, overtime).  All versions of a person lie in one hash
  bucket, so an update by key replaces the states of the buckets it touches.

A re-keyed fact takes back the states of the rows it changes: their counts and
sums come once more with the sign turned.  The dashboard queries below read
states alone and equal those over the tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import flag_label
from ..operators.aggregates import one_row
from ..operators.joins import bounded_broadcast
from ..session import materialize
from ..sources.store import BUCKETED, Store
from . import fact as factmod
from .analytics import trend_of
from .model import Warehouse

FACT_SUMS = ["reviews", "scored", "score_cents", "rating_sum"]
BUCKET_STATES = BUCKETED | {"dim_employee_state": ("bucket", 32)}


def stateful_store(spark, base: str) -> Store:
    return Store(spark, base, bucketed=BUCKET_STATES)


def fact_state(fact: DataFrame, sign=1, *apart: str) -> DataFrame:
    """State of some fact rows; ``sign`` -1 takes them back.  Rows that differ
    in the columns ``apart`` get states of their own."""
    sums = {"reviews": F.count(F.lit(1)), "scored": F.count("review_score"), "score_cents": F.sum((F.col("review_score") * 100).cast("bigint")),
            "rating_sum": F.sum(F.col("performance_rating").cast("bigint"))}
    return fact.groupBy("review_year", "department_key", *apart).agg(*[(F.coalesce(sums[c], F.lit(0)) * sign).cast("bigint").alias(c) for c in FACT_SUMS])


def dim_state(dim: DataFrame, bucket) -> DataFrame:
    """State of some whole buckets of the employee dimension."""
    d = dim.withColumn("bucket", bucket)
    cur = F.col("is_current") == 1
    people = d.filter(cur).groupBy("bucket", "department_name", "over_time_flag").agg(
        F.count(F.lit(1)).alias("headcount"), F.sum(F.col("attrition_flag").cast("bigint")).alias("leavers"), F.count("attrition_flag").alias("known"),
        F.lit(0).cast("bigint").alias("with_history"))
    more = d.groupBy("bucket", "employee_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("bucket").agg(F.count(F.lit(1)).alias("with_history"))
    return people.unionByName(more.select("bucket", *[F.lit(None).cast(people.schema[c].dataType).alias(c) for c in ("department_name", "over_time_flag")],
                                          *[F.lit(0).cast("bigint").alias(c) for c in ("headcount", "leavers", "known")], "with_history"))


def stage_fact(store: Store, rows: DataFrame, append: bool = False) -> DataFrame:
    written = store.stage("fact", rows, append=append)
    store.stage("fact_state", fact_state(written), append=append)
    return written


def stage_rekeyed(store: Store, rekeyed: DataFrame) -> DataFrame:
    """Replace the fact by ``rekeyed``; only rows that changed, went or came
    enter the states, the old ones with the sign turned."""
    old = store.read("fact")
    written = store.stage("fact", rekeyed)
    store.stage("fact_state", changed_state(old, written), append=True)
    return written


def changed_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """States of the rows that ``old`` has more often than ``new``, with the
    sign turned, and of those that ``new`` has more often: one pass counts
    every row down and up."""
    cols = ["review_id", "review_year", "department_key", "review_score", "performance_rating"]
    both = old.select(*cols, F.lit(-1).alias("_n")).unionByName(new.select(*cols, F.lit(1).alias("_n")))
    changed = both.groupBy(*cols).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    rows = changed.withColumn("_sign", F.signum("_n").cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))))
    return fact_state(rows, F.col("_sign"), "_sign").drop("_sign")


def stage_dim_employee(store: Store, dim: DataFrame) -> DataFrame:
    written = store.stage("dim_employee", dim)
    store.stage("dim_employee_state", dim_state(written, store._bucket("dim_employee")))
    return written


def update_dim_employee(store: Store, keys: DataFrame, rows: DataFrame) -> DataFrame:
    """``Store.stage_update`` of the dimension, and of its states' buckets.
    Both updates ask for the buckets of their rows before they write them, so
    the rows are computed first."""
    keys, rows = materialize(keys), materialize(rows)
    written = store.stage_update("dim_employee", keys, rows)
    bucket = store._bucket("dim_employee")
    touched = keys.select(bucket.alias("bucket")).unionByName(rows.select(bucket.alias("bucket"))).distinct()
    store.stage_update("dim_employee_state", touched, materialize(dim_state(written, bucket)))
    return written


def rekey(store: Store, dw: Warehouse, reviews: DataFrame) -> DataFrame:
    """Re-resolve the published fact against the dimensions of ``dw``."""
    return stage_rekeyed(store, factmod.rekey(store.read("fact"), reviews, dw.dim_employee, dw.dim_department, dw.dim_date, dw.dim_project))


# -- queries over states ------------------------------------------------------------
def _merged(state: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return state.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def _average(total: str, n: str, cents: bool):
    """Exact average of sums, with six places as AVG has on such decimals."""
    d = F.col(total).cast("decimal(25,0)")
    d = (d / 100).cast("decimal(25,2)") if cents else d
    return F.when(F.col(n) > 0, (d / F.col(n).cast("decimal(12,0)")).cast("decimal(16,6)" if cents else "decimal(16,4)"))


def yearly_trend(fact_states: DataFrame, dim_department: DataFrame) -> DataFrame:
    y = _merged(fact_states, ["review_year", "department_key"], FACT_SUMS).filter("reviews <> 0")
    y = y.select("review_year", "department_key", _average("score_cents", "scored", True).alias("_avg_score"), _average("rating_sum", "reviews", False).alias("_avg_rating"), "reviews")
    return trend_of(y.join(bounded_broadcast(dim_department.select("department_key", "department_name")), "department_key"))


def attrition_by_group(dim_states: DataFrame) -> DataFrame:
    g = _merged(dim_states.filter("headcount > 0"), ["department_name", "over_time_flag"], ["headcount", "leavers", "known"])
    rate = F.round((F.col("leavers").cast("decimal(20,0)") / F.col("known").cast("decimal(12,0)")).cast("decimal(14,4)") * 100, 1).cast("double")
    return g.select("department_name", flag_label("over_time_flag", "Overtime", "No overtime").alias("overtime_group"), "headcount", "leavers",
                    rate.alias("attrition_rate_pct"), "over_time_flag").orderBy("department_name", "over_time_flag").drop("over_time_flag")


def kpis(fact_states: DataFrame, dim_states: DataFrame) -> DataFrame:
    sums = lambda df, cols: df.agg(*[F.sum(c).alias(c) for c in cols])
    p = sums(dim_states, ["headcount", "leavers", "known", "with_history"])
    r = sums(fact_states, FACT_SUMS)
    rate = F.round((F.col("leavers").cast("decimal(20,0)") / F.col("known").cast("decimal(12,0)")).cast("decimal(14,4)") * 100, 1).cast("double")
    people = p.select(F.col("headcount").alias("employees"), rate.alias("attrition_pct"), "with_history")
    scores = r.select("reviews", F.round(_average("score_cents", "scored", True), 1).cast("double").alias("avg_score"))
    return one_row(people, scores).select("employees", "reviews", "avg_score", "attrition_pct", "with_history")
