"""Reject reasons and in-batch ordering of the change batches."""
import datetime as dt

from pyspark.sql import functions as F

from starloom.plans import changes as CH
from starloom.plans.model import Core

D = dt.date


def _core(spark, assignments):
    emp = spark.createDataFrame([(1, D(2020, 1, 1)), (2, D(2020, 1, 1))], "employee_id long, hire_date date")
    prj = spark.createDataFrame([(10, "A", 1, "Active", "Low"), (11, "B", 1, "Active", "Low"),
                                 (12, "C", 1, "Active", "Low")],
                                "project_id long, project_name string, department_id int, status string, priority string")
    asg = spark.createDataFrame(assignments, "employee_id long, project_id long, allocation_pct int, end_date date")
    dep = spark.createDataFrame([(1, "X"), (2, "Y"), (3, "Z")], "department_id int, department_name string")
    hist = spark.createDataFrame([(1, 1, D(2021, 1, 1), None), (1, 2, D(2020, 1, 1), D(2020, 12, 31))],
                                 "employee_id long, department_id int, effective_start date, effective_end date")
    return Core(departments=dep, employees=emp, history=hist, projects=prj, reviews=None, assignments=asg)


def test_greedy_allocation_rejected_rows_consume_nothing(spark):
    core = _core(spark, [(1, 10, 50, None), (1, 11, 30, D(2021, 1, 1))])  # 50 % open, 30 % ended
    batch = spark.createDataFrame([
        (1, 1, 11, 10),   # pair exists although ended -> rejected
        (2, 1, 12, 60),   # 50 + 60 > 100 -> rejected, consumes nothing
        (3, 1, 12, 50),   # 50 + 50 = 100 -> accepted
        (4, 1, 99, 1),    # unknown project
        (5, 3, 10, 10),   # unknown employee
        (6, 2, 12, 40), (7, 2, 12, 10),  # second request for the same new pair
    ], "seq long, employee_id long, project_id long, allocation_pct int")
    st = {r["seq"]: (r["status"], r["reason"]) for r in CH.assignment_status(core, batch).collect()}
    assert st[1] == ("rejected", "already assigned to that project")
    assert st[2] == ("rejected", "allocation over 100%")
    assert st[3] == ("accepted", None)
    assert st[4] == ("rejected", "no such project")
    assert st[5] == ("rejected", "no such employee")
    assert st[6] == ("accepted", None)
    assert st[7] == ("rejected", "already assigned to that project")


def test_department_moves_see_earlier_accepted_moves(spark):
    core = _core(spark, [(1, 10, 50, None)])
    batch = spark.createDataFrame([
        (1, 1, 2, D(2022, 1, 1)),   # accepted: open row dept 1 since 2021
        (2, 1, 2, D(2023, 1, 1)),   # already in dept 2 now
        (3, 1, 3, D(2021, 6, 1)),   # not after the current start (2022-01-01)
        (4, 1, 3, D(2022, 6, 1)),   # accepted
        (5, 2, 3, D(2022, 6, 1)),   # employee 2 has no open row
    ], "seq long, employee_id long, new_department_id int, effective_date date")
    st = {r["seq"]: (r["status"], r["reason"]) for r in CH.department_change_status(core.history, batch).collect()}
    assert st[1] == ("accepted", None)
    assert st[2] == ("rejected", "already in that department")
    assert st[3] == ("rejected", "move must be after the current role started")
    assert st[4] == ("accepted", None)
    assert st[5] == ("rejected", "no active job record")


def test_fold_state_carries_across_arrow_batches_for_a_hot_key(spark):
    """One employee with many requests, split into many tiny Arrow batches:
    the greedy cap must match a plain sequential reference."""
    import random
    rnd = random.Random(7)
    reqs = [(i, 1, 10 + rnd.randrange(3), rnd.choice([10, 20, 30, 50])) for i in range(1, 61)]
    reqs += [(100 + i, 2, 10 + (i % 3), 40) for i in range(5)]
    core = _core(spark, [(1, 10, 20, None)])
    batch = spark.createDataFrame(reqs, "seq long, employee_id long, project_id long, allocation_pct int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["seq"]: r["status"] for r in CH.assignment_status(core, batch).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    expect = {}
    state = {1: (20, {10}), 2: (0, set())}  # (used, pairs) per employee; pair (1, 10) exists
    for seq, e, p, a in sorted(reqs):
        used, pairs = state[e]
        if used + a <= 100 and p not in pairs:
            state[e] = (used + a, pairs | {p})
            expect[seq] = "accepted"
        else:
            expect[seq] = "rejected"
    assert got == expect


def test_accepted_and_rejected_are_the_batch(spark):
    """NULL ids, ids above 2**53, impossible shares and NULL dates: every
    change comes back once."""
    big = 2 ** 53 + 1
    core = _core(spark, [(1, 10, 50, None)])
    core = core.with_(projects=core.projects.unionByName(spark.createDataFrame([(big, "D", 1, "Active", "Low")], core.projects.schema)))
    asg = spark.createDataFrame([(1, 1, None, 10), (2, 1, big, 10), (3, 1, big, 10), (4, None, 10, 10), (5, 2, 11, -100), (6, 2, 11, 0),
                                 (7, 2, 11, None), (8, 2, 11, 100), (9, 2, 12, 1)],
                                "seq long, employee_id long, project_id long, allocation_pct int")
    nxt, acc, rej = CH.apply_assignments(core, asg)
    assert sorted(r["seq"] for r in acc.collect()) == [2, 8]
    assert {r["seq"]: r["reason"] for r in rej.collect()} == {
        1: "no such project", 3: "already assigned to that project", 4: "no such employee", 5: "allocation_pct:range",
        6: "allocation_pct:range", 7: "allocation_pct:range", 9: "allocation over 100%"}
    assert {(r["employee_id"], r["project_id"]) for r in nxt.assignments.collect()} == {(1, 10), (1, big), (2, 11)}
    hist = core.history.withColumn("job_level", F.lit(1)).withColumn("monthly_income", F.lit(5)) \
        .withColumn("job_role_id", F.lit(1)).withColumn("change_reason", F.lit("x"))
    moves = spark.createDataFrame([(1, 1, 2, D(2022, 1, 1)), (2, 1, None, D(2023, 1, 1)), (3, 1, 3, None), (4, None, 3, D(2023, 1, 1)),
                                   (5, 1, 99, D(2023, 1, 1)), (6, 1, 3, D(2024, 1, 1))],
                                  "seq long, employee_id long, new_department_id int, effective_date date")
    emp = core.employees.withColumn("department_id", F.lit(1))
    nxt, acc, rej = CH.apply_department_change(core.with_(history=hist, employees=emp), moves)
    assert sorted(r["seq"] for r in acc.collect()) == [1, 6]
    assert {r["seq"]: r["reason"] for r in rej.collect()} == {
        2: "no such department", 3: "effective_date:missing", 4: "no active job record", 5: "no such department"}
    rows = {(r["department_id"], r["effective_start"], r["effective_end"]) for r in nxt.history.collect()}
    assert rows == {(2, D(2020, 1, 1), D(2020, 12, 31)), (1, D(2021, 1, 1), D(2021, 12, 31)), (2, D(2022, 1, 1), D(2023, 12, 31)), (3, D(2024, 1, 1), None)}
    assert {r["employee_id"]: r["department_id"] for r in nxt.employees.collect()} == {1: 3, 2: 1}
