"""Stored group states, distributed selection and the as-of prefix scan."""
import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from starloom.operators import aggregates as AG, joins as J, windows as W
from starloom.plans import analytics as A, states
from starloom.queries.warehouse import _states
from starloom.session import materialize


def _same(a, b):
    cols = b.columns
    assert a.select(*cols).exceptAll(b).count() == 0 and b.exceptAll(a.select(*cols)).count() == 0


def test_queries_over_states_equal_the_full_ones_and_read_states_only(spark):
    """After a build in two parts, an update by key and a re-keying."""
    store, dw = _states(spark, SF_SMALL)
    moved = F.when(F.col("review_id") % 5 == 0, F.lit(dw.dim_department.agg(F.min("department_key")).first()[0])).otherwise(F.col("department_key"))
    states.stage_rekeyed(store, store.read("fact").withColumn("department_key", moved).filter("review_id % 11 <> 0"))
    store.commit()
    full = dw.with_(dim_employee=store.read("dim_employee"), fact=store.read("fact"))
    fs, ds = store.read("fact_state"), store.read("dim_employee_state")
    assert fs.filter("reviews < 0").count() > 0 and len(store.tables()["fact_state"]) == 4   # something was taken back
    for ours, want in ((states.yearly_trend(fs, dw.dim_department), A.yearly_trend(full)), (states.kpis(fs, ds), A.kpis(full)),
                       (states.attrition_by_group(ds), A.attrition_by_group(full))):
        _same(ours, want)
    for df in (states.kpis(fs, ds), states.attrition_by_group(ds)):
        assert df.inputFiles() and all("_state/" in f for f in df.inputFiles())


def test_top_values_equal_the_window_with_heavy_ties(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 1, 2, None]), r.choice([None, *range(6)]), r.choice([1.5, 2.5, -0.0, 0.0]), i) for i in range(3000)]
    df = materialize(spark.createDataFrame(rows, "k int, a int, b double, payload int"))
    for order, down in ((["a"], True), (["a", "b"], [True, False]), (["b"], False)):
        want = df.withColumn("rk", F.dense_rank().over(Window.partitionBy("k").orderBy(*W._sort_cols(order, down)))).filter("rk <= 3")
        for salts in (1, 5):
            _same(W.top_ranks(df, "k", order, 3, "rk", descending=down, salts=salts), want)


def test_no_window_sees_the_rows(spark):
    df = materialize(spark.range(1000).selectExpr("1 AS k", "id % 7 AS v", "id AS payload"))
    plan = W.top_ranks(df, "k", ["v"], 3)._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan[plan.index("Window"):].splitlines() if "Relation" not in line]
    assert len(below) > 4 and not any("payload" in line for line in below)


def test_sketches_of_any_split_unite_to_the_same_estimate(spark):
    df = materialize(spark.range(60_000).selectExpr("id % 5 AS k", "id % 23 AS part", "(id * 7919) % 9001 AS v"))
    exact = {r.k: r.n for r in AG.count_distinct(df, ["k"], "v", "n").collect()}
    got = []
    for keys in (["k"], ["k", "part"]):
        stored = materialize(AG.distinct_sketches(df, keys, "v", "s"))
        got.append({r.k: r.n for r in AG.distinct_estimate(stored, ["k"], "s", "n").collect()})
    got.append({r.k: r.n for r in AG.count_distinct(df, ["k"], "v", "n", approx=True).collect()})
    assert got[0] == got[2] and all(abs(g[k] - n) <= 5 * AG.SKETCH_ERROR * n for g in got for k, n in exact.items())
    assert all(abs(got[0][k] - got[1][k]) <= .01 * n for k, n in exact.items())


def test_the_prefix_scan_of_a_hot_employee_spans_several_tasks(spark):
    """One employee with 90 % of the events, many of them on one day."""
    r, day = random.Random(7), dt.date(2020, 1, 1)
    versions = [(e, day + dt.timedelta(30 * k), day + dt.timedelta(30 * k + (29 if k % 4 else 20)), f"{e}-{k}") for e in range(1, 8) for k in range(e, 12)]
    events = [(i, 3 if i % 10 else r.randint(0, 9), day + dt.timedelta(r.choice([200, r.randint(-10, 500)]))) for i in range(4000)] + [(9001, None, day), (9002, 3, None)]
    v = materialize(spark.createDataFrame(versions, "employee_id long, start_date date, end_date date, v string"))
    e = materialize(spark.createDataFrame(events, "eid long, employee_id long, d date").repartition(4))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = J.asof_parts(e, v, "employee_id", "d")
        assert parts.filter("_k = 3 and _kind = 1").select("_pid").distinct().count() > 2
        got = J.asof_window(e, v, "employee_id", "d").select("eid", "v")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    _same(got, J.asof(e, v, "employee_id", "d").select("eid", "v"))
