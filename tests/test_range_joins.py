"""The bucketed as-of join and the sweep-line point-in-time lookup against
brute-force joins, on edge cases (multi-year and open-ended versions, events
on boundaries and outside every version, intervals that end)."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from starloom.operators.joins import asof, first_covering
from starloom.sources.fixtures import Fixture

D = dt.date


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bucketed_asof_equals_plain_range_join(spark):
    versions = spark.createDataFrame([
        (1, D(1990, 1, 1), D(1995, 6, 30), "a"),   # spans many years
        (1, D(1995, 7, 1), D(9999, 12, 31), "b"),  # open end
        (2, D(2000, 1, 1), D(2000, 1, 1), "c"),    # one day
        (3, D(2001, 1, 1), D(2001, 12, 31), "d"),
    ], "employee_id long, start_date date, end_date date, v string")
    events = spark.createDataFrame([
        (10, 1, D(1989, 12, 31)), (11, 1, D(1990, 1, 1)), (12, 1, D(1995, 6, 30)), (13, 1, D(1995, 7, 1)),
        (14, 1, D(2024, 2, 29)), (15, 2, D(2000, 1, 1)), (16, 2, D(2000, 1, 2)), (17, 3, D(2002, 1, 1)),
        (18, 4, D(2001, 5, 5)),
    ], "eid long, employee_id long, d date")
    a = asof(events, versions, "employee_id", "d").select("eid", "v")
    b = asof(events, versions, "employee_id", "d", bucket_by_year=False).select("eid", "v")
    assert _same(a, b)
    assert sorted(tuple(r) for r in a.collect()) == [(11, "a"), (12, "a"), (13, "b"), (14, "b"), (15, "c")]


def test_sweep_line_equals_brute_force_with_ending_intervals(spark):
    f = Fixture(spark, SF_SMALL)
    asg = f.stg_assignment()  # some assignments end 90 days after they start
    assert asg.filter(F.col("end_date").isNotNull()).count() > 0
    r = f.review().select("review_id", "employee_id", "review_date")
    ours = first_covering(r, asg, "employee_id", "review_date", "review_id", "seq", "project_id") \
        .select("review_id", "project_id")
    cand = r.join(asg.select("employee_id", "start_date", "end_date", "seq", F.col("project_id").alias("p")),
                  "employee_id") \
        .filter((F.col("start_date") <= F.col("review_date"))
                & (F.col("end_date").isNull() | (F.col("review_date") <= F.col("end_date"))))
    best = cand.groupBy("review_id").agg(F.min(F.struct("seq", "p")).alias("m")) \
        .select("review_id", F.col("m.p").alias("project_id"))
    brute = r.select("review_id").join(best, "review_id", "left")
    assert _same(ours, brute)
