"""Streaming feeds: re-delivery of the same feed adds nothing."""
import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL
from starloom.session import ensure_checkpoint_dir, materialize
from starloom.sources.fixtures import fixture_core, fixture_warehouse
from starloom.streaming import feeds


def test_fact_stream_redelivery_is_idempotent(spark):
    base = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    core = fixture_core(spark, SF_SMALL)
    dw = fixture_warehouse(spark, SF_SMALL)
    dims = {k: materialize(getattr(dw, k)) for k in ("dim_employee", "dim_department", "dim_date", "dim_project")}
    core.reviews.repartition(4, F.year("review_date")).write.parquet(f"{base}/feed")
    for run in range(2):  # second run: new checkpoint, same feed, same output
        src = feeds.read_file_stream(spark, f"{base}/feed", core.reviews.schema, max_files=2)
        q = feeds.start_fact_stream(spark, src, dims, f"{base}/out", f"{base}/ckpt{run}")
        q.awaitTermination()
        n = feeds.read_fact(spark, f"{base}/out").count()
        if run == 0:
            first = n
    assert n == first == dw.fact.count()


def _scratch(spark):
    return f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"


def test_pending_reviews_are_loaded_by_a_later_feed(spark):
    """Reviews that found no employee version stay pending under one
    checkpoint and are loaded under the next, once the version is there."""
    base = _scratch(spark)
    core, dw = fixture_core(spark, SF_SMALL), fixture_warehouse(spark, SF_SMALL)
    dims = {k: materialize(getattr(dw, k)) for k in ("dim_employee", "dim_department", "dim_date", "dim_project")}
    some = core.reviews.filter("employee_id % 3 = 1")
    some.write.parquet(f"{base}/feed0")
    core.reviews.filter("employee_id % 3 <> 1").write.parquet(f"{base}/feed1")
    few = dims | {"dim_employee": dims["dim_employee"].filter("employee_id % 3 <> 1")}
    for run, have in enumerate((few, dims)):
        src = feeds.read_file_stream(spark, f"{base}/feed{run}", core.reviews.schema)
        feeds.start_fact_stream(spark, src, have, f"{base}/out", f"{base}/ckpt{run}").awaitTermination()
    got = feeds.read_fact(spark, f"{base}/out").select("review_id")
    want = dw.fact.select("review_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_two_history_feeds_build_one_dimension(spark):
    """Two checkpoints, each with several batches, over two halves of every
    employee's history: the state equals the batch build, also after a
    re-delivery under a third checkpoint."""
    from starloom.plans import scd2
    from starloom.sources.fixtures import Fixture
    base, f = _scratch(spark), Fixture(spark, SF_SMALL)
    hist, emp, dep = materialize(f.history()), materialize(f.employee()), materialize(f.department())
    for k in range(2):
        hist.filter(F.year("effective_start") % 2 == k).repartition(3, "employee_id").write.parquet(f"{base}/feed{k}")
    for run, feed in enumerate((0, 1, 0)):
        src = feeds.read_file_stream(spark, f"{base}/feed{feed}", hist.schema, max_files=2)
        feeds.start_scd2_stream(spark, src, emp, dep, f"{base}/out", f"{base}/ckpt{run}").awaitTermination()
    want = scd2.scd2_refresh(hist, emp, dep)
    got = feeds.read_latest_dim(spark, f"{base}/out").select(*want.columns)
    assert got.count() == hist.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _same(got, want):
    assert got.count() == want.count() and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_history_feeds_that_run_together(spark):
    """Two feeds started before either is awaited, over two halves of every
    employee's history, equal the batch build."""
    from starloom.plans import scd2
    from starloom.sources.fixtures import Fixture
    base, f = _scratch(spark), Fixture(spark, SF_SMALL)
    hist, emp, dep = materialize(f.history()), materialize(f.employee()), materialize(f.department())
    for k in range(2):
        hist.filter(F.year("effective_start") % 2 == k).repartition(4, "employee_id").write.parquet(f"{base}/feed{k}")
    running = [feeds.start_scd2_stream(spark, feeds.read_file_stream(spark, f"{base}/feed{k}", hist.schema, max_files=1), emp, dep, f"{base}/out", f"{base}/ckpt{k}")
               for k in range(2)]
    for q in running:
        q.awaitTermination()
    want = scd2.scd2_refresh(hist, emp, dep)
    _same(feeds.read_latest_dim(spark, f"{base}/out").select(*want.columns), want)


def test_fact_feeds_that_run_together(spark):
    """Two feeds that share half of the reviews, with reviews that wait: each
    review is loaded once, and none that is loaded still waits."""
    base = _scratch(spark)
    core, dw = fixture_core(spark, SF_SMALL), fixture_warehouse(spark, SF_SMALL)
    dims = {k: materialize(getattr(dw, k)) for k in ("dim_employee", "dim_department", "dim_date", "dim_project")}
    reviews = materialize(core.reviews)
    few = dims | {"dim_employee": dims["dim_employee"].filter("employee_id % 5 <> 1")}
    for k in range(2):
        reviews.filter(F.col("review_id") % 4 != k).repartition(2).write.parquet(f"{base}/feed{k}")

    def run(have, tags):
        running = [feeds.start_fact_stream(spark, feeds.read_file_stream(spark, f"{base}/feed{k}", reviews.schema, max_files=1), have, f"{base}/out", f"{base}/{t}")
                   for k, t in enumerate(tags)]
        for q in running:
            q.awaitTermination()
    run(few, ["a0", "a1"])
    got = feeds.read_fact(spark, f"{base}/out").select("review_id")
    _same(got, dw.fact.filter("employee_id % 5 <> 1").select("review_id"))
    assert feeds.read_waiting(spark, f"{base}/out").join(got, "review_id").count() == 0
    run(dims, ["b0", "b1"])     # the missing versions are there, and all is delivered again
    _same(feeds.read_fact(spark, f"{base}/out").select("review_id"), dw.fact.select("review_id"))


def test_many_batches_leave_few_parts(spark):
    """After 18 batches the dimension and the history have at most FANOUT - 1
    parts a level, and shadowed rows are gone from merged ones."""
    from starloom.plans import scd2
    from starloom.sources.fixtures import Fixture
    base, f = _scratch(spark), Fixture(spark, SF_SMALL)
    emp, dep = materialize(f.employee()), materialize(f.department())
    hist = materialize(f.history().filter("employee_id < 40"))
    hist.repartition(18, "employee_id", "effective_start").write.option("maxRecordsPerFile", 0).parquet(f"{base}/feed")
    src = feeds.read_file_stream(spark, f"{base}/feed", hist.schema, max_files=1)
    feeds.start_scd2_stream(spark, src, emp, dep, f"{base}/out", f"{base}/ckpt").awaitTermination()
    store = feeds._dim_store(spark, f"{base}/out")
    for table in ("dim_employee", "history"):
        levels = [u["level"] for u in store.units(table)]
        assert all(levels.count(x) < feeds.FANOUT for x in levels) and len(levels) <= 6, levels
        assert len(store.read(table).inputFiles()) <= 4 * len(levels)
    assert store.notes()["seq"] >= 15
    want = scd2.scd2_refresh(hist, emp, dep)
    _same(feeds.read_latest_dim(spark, f"{base}/out").select(*want.columns), want)


def test_a_retried_batch_changes_nothing(spark):
    """The function of a committed batch, called again, and a crash between a
    batch's two commits."""
    from starloom.plans import scd2
    from starloom.sources.fixtures import Fixture
    base, f = _scratch(spark), Fixture(spark, SF_SMALL)
    hist, emp, dep = materialize(f.history()), materialize(f.employee()), materialize(f.department())
    hist.write.parquet(f"{base}/feed")
    store = feeds._dim_store(spark, f"{base}/out")     # what a batch leaves that died after its first commit
    store.stage("history", hist, append=True)
    name = feeds._feed(f"{base}/ckpt")
    store.commit(lambda notes: {"seq": 1, name: {"batch": 0, "seq": 1, "done": False}})
    for _ in range(2):
        src = feeds.read_file_stream(spark, f"{base}/feed", hist.schema)
        feeds.start_scd2_stream(spark, src, emp, dep, f"{base}/out", f"{base}/ckpt").awaitTermination()
    store.refresh()
    assert store.notes() == {"seq": 1, name: {"batch": 0, "seq": 1, "done": True}} and len(store.units("dim_employee")) == 1
    want = scd2.scd2_refresh(hist, emp, dep)
    _same(feeds.read_latest_dim(spark, f"{base}/out").select(*want.columns), want)


def test_reviews_wait_for_history_that_arrives_after_them(spark):
    """The review feed and the history feed run together; the fact is loaded
    against the dimension that the history feed has built so far.  In the end all is as
    in the batch, and nothing waits but what the batch does not resolve."""
    from starloom.plans import fact as factmod, scd2
    from starloom.sources.fixtures import Fixture
    base, f = _scratch(spark), Fixture(spark, SF_SMALL)
    core, dw = fixture_core(spark, SF_SMALL), fixture_warehouse(spark, SF_SMALL)
    hist, emp, dep = materialize(f.history()), materialize(f.employee()), materialize(f.department())
    others = {k: materialize(getattr(dw, k)) for k in ("dim_department", "dim_date", "dim_project")}
    late = materialize(hist.filter("employee_id % 7 <> 1"))       # some employees' history never comes
    late.repartitionByRange(3, F.col("effective_start").desc()).write.parquet(f"{base}/history")
    reviews = materialize(core.reviews)
    reviews.repartition(2).write.parquet(f"{base}/reviews")
    none = scd2.scd2_refresh(late.limit(0), emp, dep)

    def dims():
        store = feeds._dim_store(spark, f"{base}/dim")
        return others | {"dim_employee": feeds.read_latest_dim(spark, f"{base}/dim") if "dim_employee" in store.tables() else none}
    running = [feeds.start_fact_stream(spark, feeds.read_file_stream(spark, f"{base}/reviews", reviews.schema, max_files=1), dims, f"{base}/out", f"{base}/c0"),
               feeds.start_scd2_stream(spark, feeds.read_file_stream(spark, f"{base}/history", hist.schema, max_files=1), emp, dep, f"{base}/dim", f"{base}/c1")]
    for q in running:
        q.awaitTermination()
    waits = feeds.load_waiting(spark, dims, f"{base}/out")
    full = scd2.scd2_refresh(late, emp, dep)
    want = factmod.load_fact(reviews, full, dw.dim_department, dw.dim_date, dw.dim_project)
    got = feeds.read_fact(spark, f"{base}/out")
    _same(got.select("review_id", "employee_key", "review_year"), want.select("review_id", "employee_key", "review_year"))
    reasons = feeds.unresolved_by(spark, dims, f"{base}/out", "2100-01-01")
    assert 0 < waits == reasons.count() and reasons.select("reason").distinct().count() == 1
    assert feeds.unresolved_by(spark, dims, f"{base}/out", "1900-01-01").count() == 0
