"""Concurrent commits, updates by key, and the index of parts."""
import random
import threading

import pytest
from pyspark.sql import functions as F

from starloom.sources import part_index
from starloom.sources.commit_log import CommitLog
from starloom.sources.store import Conflict, Store


def together(*work):
    """Run the functions at once; their results or exceptions."""
    out, start = [None] * len(work), threading.Barrier(len(work))

    def run(i, fn):
        start.wait()
        try:
            out[i] = fn()
        except Exception as e:  # noqa: BLE001
            out[i] = e
    threads = [threading.Thread(target=run, args=x) for x in enumerate(work)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_a_version_has_one_winner(spark, tmp_path):
    logs = [CommitLog(spark, str(tmp_path / "log")) for _ in range(6)]
    for n in range(1, 41):
        won = together(*[lambda log=log, i=i: log.claim(n, {"by": i}) for i, log in enumerate(logs)])
        assert sorted(won) == [False] * 5 + [True]
        assert logs[0].latest() == n and logs[0].read(n) == {"by": won.index(True)}
    assert not [f for f in (tmp_path / "log").iterdir() if f.name.startswith(".")]


def test_appends_at_once_all_land_once(spark, tmp_path):
    base = str(tmp_path / "dw")
    Store(spark, base).publish({"t": spark.range(0)})
    stores = [Store(spark, base), Store(spark, base)]
    for n in range(20):
        frames = [spark.range(100 * n + 10 * i, 100 * n + 10 * i + 3) for i in range(2)]
        for s, f in zip(stores, frames):
            s.stage("t", f, append=True)
        versions = together(*[s.commit for s in stores])
        assert sorted(versions) == [2 * n + 2, 2 * n + 3]
    want = sorted(100 * n + 10 * i + k for n in range(20) for i in range(2) for k in range(3))
    assert sorted(r.id for r in Store(spark, base).read("t").collect()) == want


def test_a_replace_against_a_changed_table_conflicts(spark, tmp_path):
    base = str(tmp_path / "dw")
    Store(spark, base).publish({"t": spark.range(5), "u": spark.range(1)})
    for n in range(8):
        a, b = Store(spark, base), Store(spark, base)
        before = Store(spark, base)
        rows, version = before.read("t").count(), before.current_version()
        a.stage("t", spark.range(5))
        b.stage("t", spark.range(1000, 1003), append=True)
        got = together(a.commit, b.commit)
        now = Store(spark, base)
        if isinstance(got[0], Conflict):   # the append came first
            assert now.current_version() == version + 1 and now.read("t").count() == rows + 3
        else:                              # the replace came first, the append was added to it
            assert now.current_version() == version + 2 and now.read("t").count() == 8
        assert not isinstance(got[1], Exception)
    a, b = Store(spark, base), Store(spark, base)
    a.stage("t", spark.range(5))
    a.stage("u", spark.range(7))
    b.append_table("t", spark.range(1))
    with pytest.raises(Conflict):
        a.commit()
    assert Store(spark, base).read("u").count() == 1      # nothing of the failed commit is visible
    assert a.refresh().append_table("u", spark.range(1))  # and the store goes on
    assert Store(spark, base).read("u").count() == 2


def people(spark, n, first=0):
    return spark.range(first, first + n).selectExpr("id AS employee_id", "id * 10 AS pay").unionAll(spark.range(first, first + n).selectExpr("id", "id * 10 + 1"))


def test_an_update_of_one_key_rewrites_one_bucket(spark, tmp_path):
    s = Store(spark, str(tmp_path / "dw"), bucketed={"dim_employee": ("employee_id", 8)})
    s.publish({"dim_employee": people(spark, 100)})
    before = {u["bucket"]: u["part"] for u in s.units("dim_employee")}
    assert sorted(before) == list(range(8))
    key = spark.createDataFrame([(17,)], "employee_id long")
    assert sorted(r.pay for r in s.rows_of_keys("dim_employee", key).collect()) == [170, 171]
    s.update_table("dim_employee", key, spark.createDataFrame([(17, -1), (17, -2), (17, -3)], "employee_id long, pay long"))
    after = {u["bucket"]: u["part"] for u in s.units("dim_employee")}
    assert sum(before[b] != after[b] for b in before) == 1 and sorted(after) == sorted(before)
    got = Store(spark, s.base, bucketed=s.bucketed).read("dim_employee")
    assert got.count() == 201 and sorted(r.pay for r in got.filter("employee_id = 17").collect()) == [-3, -2, -1]
    # keys that are new to the table, and keys that lose all rows
    s.update_table("dim_employee", spark.createDataFrame([(500,), (3,)], "employee_id long"), people(spark, 1, 500))
    assert s.read("dim_employee").filter("employee_id in (3, 500)").count() == 2


def test_updates_of_different_buckets_add_up_and_of_one_conflict(spark, tmp_path):
    base, kind = str(tmp_path / "dw"), {"dim_employee": ("employee_id", 8)}
    first = Store(spark, base, bucketed=kind)
    first.publish({"dim_employee": people(spark, 60)})
    bucket = {r.employee_id: r.b for r in people(spark, 60).select("employee_id", first._bucket("dim_employee").alias("b")).distinct().collect()}
    other = next(k for k in bucket if bucket[k] != bucket[0])
    same = next(k for k in bucket if bucket[k] == bucket[0] and k)
    for second, fails in ((other, False), (same, True)):
        stores = [Store(spark, base, bucketed=kind) for _ in range(2)]
        for s, k in zip(stores, (0, second)):
            s.stage_update("dim_employee", spark.createDataFrame([(k,)], "employee_id long"), spark.createDataFrame([(k, -5)], "employee_id long, pay long"))
        got = together(*[s.commit for s in stores])
        assert sum(isinstance(x, Conflict) for x in got) == int(fails) and not any(isinstance(x, Exception) and not isinstance(x, Conflict) for x in got)
    now = Store(spark, base, bucketed=kind).read("dim_employee")
    assert now.filter("employee_id = 0").count() == 1 and now.count() in (117, 118)  # the last round had one winner


def facts(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("id AS review_id", "id % 50 AS employee_id", "CAST(20200000 + id % 300 AS INT) AS date_key", "CAST(2020 + id DIV 1000 AS INT) AS review_year")


def read_paths(df):
    return [p for p in df.inputFiles()]


def test_new_keys_read_no_file_and_seen_keys_their_units(spark, tmp_path):
    s = Store(spark, str(tmp_path / "dw"))
    s.publish({"fact": facts(spark, 0, 3000)})
    s.append_table("fact", facts(spark, 3000, 3500))
    assert len(s.units("fact")) == 4
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "review_id long")
    assert read_paths(s.rows_that_may_hold("fact", spark.range(5000, 9000).toDF("review_id"), ["review_id"])) == []
    hit = s.rows_that_may_hold("fact", ids(1500, 3400, 99_999), ["review_id"])
    assert {u["sub"] for u in s.units_that_may_hold("fact", ids(1500, 3400, 99_999), ["review_id"])} == {"review_year=2021", "review_year=2023"}
    assert all("review_year=2021" in p or "review_year=2023" in p for p in read_paths(hit)) and hit.filter("review_id in (1500, 3400)").count() == 2
    day = spark.createDataFrame([(7, 20200007)], "employee_id long, date_key int")
    assert s.rows_that_may_hold("fact", day, ["employee_id", "date_key"]).join(day, ["employee_id", "date_key"], "left_semi").count() == s.read("fact").join(day, ["employee_id", "date_key"], "left_semi").count()
    assert read_paths(s.rows_that_may_hold("fact", spark.createDataFrame([(None,)], "review_id long"), ["review_id"])) == []
    assert s.units_that_may_hold("fact", ids(1), ["employee_id"]) == s.units("fact")  # no index on that


@pytest.mark.parametrize("small", [20_000, 10])
def test_no_false_miss_and_few_false_hits(spark, monkeypatch, small):
    monkeypatch.setattr(part_index, "SMALL", small)  # indexed on the driver, and by aggregation
    r = random.Random(3)
    for n in (1, 60, 3000):
        have = {r.randrange(-10 ** 12, 10 ** 12) for _ in range(n)}
        built = part_index.build(spark.createDataFrame([(k,) for k in have], "k long"), F.lit("u"), [["k"]])
        unit = (built["u"]["zones"], lambda: built["u"]["filters"]["k"])
        for k in r.sample(sorted(have), min(n, 4)):
            assert part_index.units_that_may_hold(spark.createDataFrame([(k,)], "k long"), ["k"], [unit]) == [0]
        assert part_index.units_that_may_hold(spark.createDataFrame([(k,) for k in have], "k long"), ["k"], [unit]) == [0]
        other = [k for k in (r.randrange(-10 ** 12, 10 ** 12) for _ in range(400)) if k not in have]
        words = part_index.np.frombuffer(unit[1](), part_index.np.int64)
        spread = spark.createDataFrame([(k,) for k in other], "k long").select(*part_index._hashes(["k"])).collect()
        hit = [all(words[p >> 6] >> (p & 63) & 1 for p in ((x[0] + i * x[1]) & (len(words) * 64 - 1) for i in range(part_index.HASHES))) for x in spread]
        assert sum(hit) <= 2
        assert part_index.units_that_may_hold(spark.createDataFrame([(k,) for k in have], "k long"), ["k"], [unit] * 3 + [({"k": [None, None]}, unit[1])]) == [0, 1, 2]
    assert part_index.build(spark.createDataFrame([(5,)], "k int"), F.lit("u"), [["k"]])["u"]["filters"] == \
        part_index.build(spark.createDataFrame([(5,)], "k long"), F.lit("u"), [["k"]])["u"]["filters"]


def test_units_out_of_bounds_are_left_out_before_their_filters_are_read(spark, monkeypatch):
    monkeypatch.setattr(part_index, "MANY", 2)
    built = part_index.build(spark.range(100, 200).toDF("k"), F.when(F.col("k") < 150, "low").otherwise("high"), [["k"]])
    read = []
    units = [(built[u]["zones"], lambda u=u: read.append(u) or built[u]["filters"]["k"]) for u in ("low", "high", "low")]
    assert part_index.units_that_may_hold(spark.createDataFrame([(160,), (170,)], "k long"), ["k"], units) == [1] and read == ["high"]
    assert part_index.units_that_may_hold(spark.createDataFrame([(None,)], "k long"), ["k"], units) == []
