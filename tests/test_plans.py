"""Plan-shape assertions: the physical plans are the ones intended."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from starloom.operators import joins as J, windows as W
from starloom.plans import analytics as A
from starloom.sources.fixtures import Fixture, fixture_warehouse


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_anti_join_is_left_anti(spark):
    f = Fixture(spark, SF_SMALL)
    p = _plan(J.not_in(f.employee(), f.review(), "employee_id"))
    assert "LeftAnti" in p


def test_first_per_uses_window_group_limit(spark):
    f = Fixture(spark, SF_SMALL)
    df = W.first_per(f.review(), ["employee_id", "review_date"], ["review_id"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p


def test_no_python_udf_in_warehouse_queries(spark):
    dw = fixture_warehouse(spark, SF_SMALL)
    for df in (A.yearly_trend(dw), A.top_performers(dw, 1998), A.project_bottlenecks(dw), A.kpis(dw)):
        p = _plan(df)
        assert not any(x in p for x in ("BatchEvalPython", "ArrowEvalPython", "InPandas", "InArrow"))


def test_filters_and_columns_reach_the_scan(spark):
    f = Fixture(spark, SF_SMALL)
    o = f._t("orders").filter(F.col("o_orderdate") >= "1996-01-01").select("o_orderkey")
    p = o._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_global_rank_equals_plain_rank(spark):
    """The distributed RANK() (range partitions + per-partition offsets)
    equals a plain single-partition rank on a small input, ties included."""
    from pyspark.sql import Window
    f = Fixture(spark, SF_SMALL)
    g = f.review().groupBy("employee_id").agg(F.count(F.lit(1)).alias("n"))
    ours = W.with_rank(g, ["n"], True, "rk").select("employee_id", "rk")
    plain = g.select("employee_id", F.rank().over(Window.orderBy(F.col("n").desc())).alias("rk"))
    assert ours.exceptAll(plain).count() == 0 and plain.exceptAll(ours).count() == 0


def test_keyed_lead_and_lag_equal_plain_windows(spark):
    from pyspark.sql import Window
    h = Fixture(spark, SF_SMALL).history().select("employee_id", "effective_start", "job_level")
    w = Window.partitionBy("employee_id").orderBy("effective_start")
    plain = h.select("*", F.lead("effective_start").over(w).alias("nxt"), F.lag("job_level").over(w).alias("prv"))
    ours = W.keyed_lead(h, "employee_id", "effective_start", "effective_start", "nxt")
    ours = W.keyed_lead(ours, "employee_id", "effective_start", "job_level", "prv", descending=True)
    cols = ["employee_id", "effective_start", "job_level", "nxt", "prv"]
    assert ours.select(*cols).exceptAll(plain.select(*cols)).count() == 0
    assert plain.select(*cols).exceptAll(ours.select(*cols)).count() == 0


def test_department_top_k_is_reduced_before_the_shuffle(spark):
    """A department with a huge headcount is cut to its top ranks on the map
    side (partial WindowGroupLimit) before the per-department window."""
    dw = fixture_warehouse(spark, SF_SMALL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(A.top_performers(dw, 1998, 5))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("WindowGroupLimit") >= 2


def _published_fact(spark, tmp_path):
    from starloom.sources.store import Store
    dw = fixture_warehouse(spark, SF_SMALL)
    store = Store(spark, str(tmp_path / "dw"))
    store.publish({"fact": dw.fact})
    return dw.with_(fact=store.read("fact"))


def test_one_year_reads_one_partition_of_the_published_fact(spark, tmp_path):
    dw = _published_fact(spark, tmp_path)
    p = _plan(A.top_performers(dw, 1998))
    assert "PartitionFilters: [isnotnull(review_year" in p and "(review_year#" in p and " = 1998)" in p


def test_a_file_batch_prunes_the_published_fact_by_its_years(spark, tmp_path):
    from starloom.plans import fact as factmod
    dw = _published_fact(spark, tmp_path)
    Fixture(spark, SF_SMALL).review().filter("year(review_date) = 1997").write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    p = _plan(factmod.new_reviews(batch, dw.fact))
    assert " = 1997)" in p.split("PartitionFilters")[-1] or any(" = 1997)" in part.split("]")[0] for part in p.split("PartitionFilters: [")[1:])


def test_rank_never_shuffles_rows_by_the_rank_value(spark):
    """Rows of one tie group are counted, not gathered: the only exchange on
    the order column carries partial counts or join sides Spark can split."""
    g = spark.range(1000).select((F.col("id") % 3).alias("n"), "id")
    p = _plan(W.with_rank(g, ["n"], True, "rk", few_values=True))
    assert "Window" not in p.split("Join")[0] or "partial_count" in p


def test_point_in_time_lookup_keeps_large_ids_and_uses_no_python(spark):
    big = 2 ** 53 + 1
    ev = spark.createDataFrame([(big, 1, "2020-05-10"), (big + 1, 1, "2020-07-10"), (big + 2, 2, None)], "review_id long, k long, d string") \
        .select("review_id", "k", F.to_date("d").alias("d"))
    iv = spark.createDataFrame([(1, "2020-01-01", "2020-05-31", 2, big + 7), (1, "2020-05-01", None, 1, big + 9), (1, None, None, 0, 5)],
                               "k long, s string, e string, seq long, p long") \
        .select("k", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"), "seq", "p")
    out = J.first_covering(ev, iv, "k", "d", "review_id", "seq", "p")
    assert "InPandas" not in _plan(out) and "InArrow" not in _plan(out)
    assert {r["review_id"]: r["p"] for r in out.collect()} == {big: big + 9, big + 1: big + 9, big + 2: None}
