"""Benchmark: full warehouse build + analytics at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.

Stages timed:
  core_load      staging tables -> gated core (checkpointed)
  etl_full       calendar, departments, projects, SCD2 employees and the fact
                 built and published (parquet, fact partitioned by year)
  <analytics>    each dashboard query on the published warehouse
  refresh_1pct   incremental fact load of the newest ~1 % of reviews
  rerun_fact     a second fact load of the same feed (adds 0 rows)
"""
from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from functools import partial

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from starloom.plans import analytics as A, core_load as CL, fact as factmod  # noqa: E402
from starloom.plans.etl import run_full  # noqa: E402
from starloom.plans.model import Core, Warehouse  # noqa: E402
from starloom.session import local_session  # noqa: E402
from starloom.sources.fixtures import FIXTURE_END, FIXTURE_START, Fixture, fixture_core  # noqa: E402
from starloom.sources.store import Store  # noqa: E402


def replicate(core: Core, k: int) -> Core:
    """BENCH_REPLICAS=k: k copies of the people and their reviews with
    offset keys (same departments and projects), to measure the build at a
    volume comparable to the reference's ~100k employees / ~390k reviews."""
    if k <= 1:
        return core
    OFF = 1_000_000_000
    rep = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_r")

    def shift(df, cols):
        out = df.select("*", rep)
        for c in cols:
            out = out.withColumn(c, F.col(c) + F.col("_r") * OFF)
        return out.drop("_r")
    return core.with_(employees=shift(core.employees, ["employee_id"]),
                      history=shift(core.history, ["employee_id"]),
                      reviews=shift(core.reviews, ["employee_id", "review_id"]))


def timed(fn):
    t = time.time()
    out = fn()
    return out, time.time() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n = int(cpus) if cpus.isdigit() else (os.cpu_count() or 8)
    spark = local_session(cpus if cpus.isdigit() else "*", shuffle_partitions=n * 2, app="starloom-bench")
    scratch = tempfile.mkdtemp(prefix="starloom-bench-")
    store = Store(spark, f"{scratch}/dw")
    q: dict[str, float] = {}

    # setup (untimed): the fixture staging and core tables written as files,
    # the way a deployment reads them
    fx = Fixture(spark, sf_dir)
    stg_src = fx.staging()
    stg_names = ["snapshot", "history", "projects", "assignments", "reviews"]
    for n in stg_names:
        getattr(stg_src, n).write.parquet(f"{scratch}/staging/{n}")
    core_src = replicate(fixture_core(spark, sf_dir), int(os.environ.get("BENCH_REPLICAS", "1")))
    core_names = ["departments", "employees", "history", "projects", "reviews"]
    for n in core_names:
        getattr(core_src, n).write.parquet(f"{scratch}/core/{n}")

    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, untimed

    # staging -> core (gated, checkpointed)
    stg = CL.Staging(**{n: spark.read.parquet(f"{scratch}/staging/{n}") for n in stg_names})
    _, q["core_load"] = timed(lambda: CL.run_core_load(stg))

    # full warehouse build, published
    core = Core(**{n: spark.read.parquet(f"{scratch}/core/{n}") for n in core_names})

    def build():
        # each dimension is staged as a store table as soon as it is built;
        # the fact load reads the staged files; one manifest switch at the end
        dw = run_full(spark, core, FIXTURE_START, FIXTURE_END, keep=store.stage)
        store.stage("fact", dw.fact)
        store.commit()
    _, q["etl_full"] = timed(build)

    t = store.read_all()
    dw = Warehouse(t["dim_date"], t["dim_department"], t["dim_project"], t["dim_employee"], t["fact"])
    analytics = {
        "yearly_trend": lambda: A.yearly_trend(dw),
        "kpis": lambda: A.kpis(dw),
        "top_performers": lambda: A.top_performers(dw, None, 5),
        "attrition_by_group": lambda: A.attrition_by_group(dw),
        "attrition_risk_list": lambda: A.attrition_risk_list(dw, 20),
        "project_bottlenecks": lambda: A.project_bottlenecks(dw, 20),
        "first_multi_version_history": lambda: A.first_multi_version_history(dw),
    }
    for name, fn in analytics.items():
        _, q[name] = timed(lambda: fn().collect())

    # incremental refresh: the newest ~1 % of reviews arrive after the build
    cutoff = core.reviews.select(F.percentile_approx("review_date", 0.99).alias("c")).first()["c"]
    old = core.reviews.filter(F.col("review_date") < F.lit(cutoff))
    core.reviews.filter(F.col("review_date") >= F.lit(cutoff)).write.parquet(f"{scratch}/batch")
    batch = spark.read.parquet(f"{scratch}/batch")
    inc_store = Store(spark, f"{scratch}/dw_inc")

    def refresh():
        f0 = factmod.load_fact(old, dw.dim_employee, dw.dim_department, dw.dim_date, dw.dim_project)
        inc_store.publish({"fact": f0})
        t0 = time.time()
        add = factmod.load_fact(batch, dw.dim_employee, dw.dim_department, dw.dim_date, dw.dim_project, known=partial(inc_store.rows_that_may_hold, "fact"))
        inc_store.append_table("fact", add)
        return time.time() - t0
    q["refresh_1pct"], _ = timed(refresh)

    def rerun():
        add = factmod.load_fact(core.reviews, dw.dim_employee, dw.dim_department, dw.dim_date, dw.dim_project,
                                fact=dw.fact)
        return add.count()
    n_rerun, q["rerun_fact"] = timed(rerun)
    assert n_rerun == 0, n_rerun

    q = {k: round(v, 3) for k, v in q.items()}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "warehouse_build_plus_analytics", "value": round(sum(q.values()), 3),
           "unit": "sec", "queries": q, "sf": float(m.group(1)) if m else sf_dir}
    if os.environ.get("BENCH_REPLICAS", "1") != "1":
        out["replicas"] = int(os.environ["BENCH_REPLICAS"])
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
