"""Rule-checked change batches.

Each operator takes the current core tables and a batch of changes with an
explicit ``seq`` (arrival order) and returns ``(core', accepted, rejected)``;
a change sees the effect of every earlier accepted change, and the first
failing rule (in the order the entry forms check them) is the reject reason.

Order-free rules ("email must be new", "employee must exist", ranges, NULLs)
are joins, aggregates and column conditions, and decide every change they
can.  Only changes of an employee with two or more undecided ones (department
moves, the 100 % allocation cap) run as a streaming fold: the batch is hash-partitioned by employee,
sorted by (employee, seq) inside each partition and folded by
``mapInPandas``, which carries one employee's small state across Arrow
batches -- a key's changes are streamed, never collected into one group.
"""
from __future__ import annotations

import sys
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import review_score
from ..functions.text import strip_all
from ..operators.quality import employee_reasons, project_reasons, review_reasons
from ..operators.windows import global_positions, keyed_lead
from ..schemas import DEFAULTS
from ..session import materialize
from .model import Core

STATUS = "status"
REASON = "reason"

# The fold functions run in Python workers, which need not have this package
# installed: ship this module's code by value with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tagged.filter(F.col(STATUS) == "accepted"), tagged.filter(F.col(STATUS) == "rejected")


def _first_valid_per_key(df: DataFrame, key: F.Column, valid: F.Column) -> DataFrame:
    """Flag the earliest valid row per key (aggregate + join, skew-safe)."""
    d = df.withColumn("_key", key)
    firsts = d.filter(valid).groupBy("_key").agg(F.min("seq").alias("_first_seq"))
    return d.join(firsts, "_key", "left")


def _with_defaults(changes: DataFrame, table: str) -> DataFrame:
    """Column defaults for columns that the batch lacks or leaves NULL."""
    for c, v in DEFAULTS[table].items():
        changes = changes.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in changes.columns else F.lit(v))
    return changes


def _missing(changes: DataFrame, cols) -> list:
    return [F.when(F.col(c).isNull(), F.lit(f"{c}:missing")) for c in cols if c in changes.columns]


def _known(changes: DataFrame, col: str, parent: DataFrame | None, key: str | None = None) -> DataFrame:
    """Adds ``_no_<col>``: the value is not in the parent table (NULL is not)."""
    if parent is None:
        return changes.withColumn(f"_no_{col}", F.col(col).isNull())
    ids = parent.select(F.col(key or col).alias(f"_p_{col}")).distinct()
    j = changes.join(ids, changes[col] == ids[f"_p_{col}"], "left")
    return j.withColumn(f"_no_{col}", F.col(f"_p_{col}").isNull()).drop(f"_p_{col}")


def _tag(c: DataFrame, reason, columns) -> DataFrame:
    return c.withColumn(REASON, reason).withColumn(STATUS, F.when(F.col(REASON).isNull(), "accepted").otherwise("rejected")) \
        .select(*columns, REASON, STATUS)


def _as_table(rows: DataFrame, table: DataFrame, **values) -> DataFrame:
    """``rows`` in the columns and types of ``table``; what they lack is NULL."""
    return rows.select(*[(values[c] if c in values else F.col(c) if c in rows.columns else F.lit(None))
                         .cast(table.schema[c].dataType).alias(c) for c in table.columns])


def _numbered(acc: DataFrame, table: DataFrame, key: str, new: str) -> DataFrame:
    """Next ids of the table, in arrival order."""
    base = table.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()
    return global_positions(acc, ["seq"], False, "_pos").withColumn(new, base + F.col("_pos")).drop("_pos")


# --------------------------------------------------------------- onboarding
def apply_onboarding(core: Core, changes: DataFrame) -> tuple[Core, DataFrame, DataFrame]:
    """New employees: entity rules, required columns, known department and
    role, then the e-mail must be new (in the table or earlier in the batch).
    Texts are stripped and column defaults filled in.  Accepted rows get the
    next employee ids (in seq order) and their first history row (Initial
    Hire)."""
    c = _with_defaults(changes, "employees")
    required = _missing(c, ["gender", "marital_status", "education_field", "hire_date"])
    c = _known(_known(c, "department_id", core.departments), "job_role_id", core.job_roles)
    c = c.withColumn("_vreason", F.coalesce(
        *employee_reasons(c), *required, F.when(F.col("_no_department_id"), F.lit("department_id:unknown")),
        F.when(F.col("_no_job_role_id"), F.lit("job_role_id:unknown"))))
    c = _first_valid_per_key(c, F.lower(strip_all(F.col("email"))), F.col("_vreason").isNull())
    known = core.employees.select(F.lower(F.col("email")).alias("_key")).distinct().withColumn("_exists", F.lit(True))
    c = c.join(known, "_key", "left")
    reason = F.coalesce(F.col("_vreason"), F.when(F.col("_exists") | (F.col("seq") != F.col("_first_seq")), F.lit("email already exists")))
    columns = [*changes.columns, *[d for d in DEFAULTS["employees"] if d not in changes.columns]]
    acc, rej = _split(_tag(c, reason, columns))
    acc = _numbered(acc, core.employees, "employee_id", "new_employee_id")
    for name in ("first_name", "last_name"):
        acc = acc.withColumn(name, strip_all(name))
    acc = acc.withColumn("email", F.lower(strip_all("email")))
    new_emp = _as_table(acc, core.employees, employee_id=F.col("new_employee_id"))
    first = _as_table(acc, core.history, employee_id=F.col("new_employee_id"), effective_start=F.col("hire_date"),
                      effective_end=F.lit(None), change_reason=F.lit("Initial Hire"))
    nxt = core.with_(employees=core.employees.unionByName(new_emp), history=core.history.unionByName(first))
    return nxt, acc, rej


# --------------------------------------------------------------- projects
def apply_projects(core: Core, changes: DataFrame) -> tuple[Core, DataFrame, DataFrame]:
    """New projects: defaults, entity rules, known department, then the
    (stripped) name must be new."""
    c = _known(_with_defaults(changes, "projects"), "department_id", core.departments)
    c = c.withColumn("_vreason", F.coalesce(*project_reasons(c), F.when(F.col("_no_department_id"), F.lit("department_id:unknown"))))
    c = _first_valid_per_key(c, strip_all(F.col("project_name")), F.col("_vreason").isNull())
    known = core.projects.select(F.col("project_name").alias("_key")).distinct().withColumn("_exists", F.lit(True))
    c = c.join(known, "_key", "left")
    reason = F.coalesce(F.col("_vreason"), F.when(F.col("_exists") | (F.col("seq") != F.col("_first_seq")), F.lit("project name already exists")))
    # the batch's own status column gives way to the change's status
    c = c.withColumn("project_status", F.col("status"))
    columns = [x for x in dict.fromkeys([*changes.columns, *DEFAULTS["projects"], "project_status"]) if x != "status"]
    acc, rej = _split(_tag(c, reason, columns))
    acc = _numbered(acc, core.projects, "project_id", "new_project_id").withColumn("project_name", strip_all("project_name"))
    new = _as_table(acc, core.projects, project_id=F.col("new_project_id"), status=F.col("project_status"))
    return core.with_(projects=core.projects.unionByName(new)), acc, rej


# --------------------------------------------------------------- reviews
def apply_reviews(core: Core, changes: DataFrame) -> tuple[Core, DataFrame, DataFrame]:
    """Reviews: entity rules, employee and project (if given) must exist, not
    before the hire date, one per employee-day (table or earlier accepted in
    the batch).  The score is computed and the next review ids are given out
    in seq order; an id in the batch is not used."""
    c = _with_defaults(changes, "performance_reviews")
    c = c if "project_id" in c.columns else c.withColumn("project_id", F.lit(None).cast("long"))
    c = c if core.projects is None else _known(c, "project_id", core.projects)
    no_project = F.col("project_id").isNotNull() & (F.col("_no_project_id") if core.projects is not None else F.lit(False))
    emp = core.employees.select("employee_id", F.col("hire_date").alias("_hire"), F.lit(True).alias("_emp"))
    c = c.join(emp, "employee_id", "left")
    day_taken = core.reviews.select("employee_id", "review_date").distinct().withColumn("_taken", F.lit(True))
    c = c.join(day_taken, ["employee_id", "review_date"], "left")
    again = F.lit("already has a review on that date")
    c = c.withColumn("_pre", F.coalesce(
        *review_reasons(c), F.when(F.col("_emp").isNull(), F.lit("no such employee")),
        F.when(F.col("review_date").isNull(), F.lit("review_date:missing")), F.when(no_project, F.lit("no such project")),
        F.when(F.col("review_date") < F.col("_hire"), F.lit("review dated before hire date")), F.when(F.col("_taken"), again)))
    firsts = c.filter(F.col("_pre").isNull()).groupBy("employee_id", "review_date").agg(F.min("seq").alias("_first_seq"))
    c = c.join(firsts, ["employee_id", "review_date"], "left")
    reason = F.coalesce(F.col("_pre"), F.when(F.col("seq") != F.col("_first_seq"), again))
    columns = [x for x in dict.fromkeys([*changes.columns, "project_id", "percent_salary_hike"]) if x not in ("review_id", "review_score")]
    tagged = _tag(c, reason, columns).withColumn("review_score", F.when(F.col(STATUS) == "accepted", review_score(
        "performance_rating", "job_satisfaction", "environment_satisfaction", "work_life_balance")))
    acc, rej = _split(tagged)
    acc = _numbered(acc, core.reviews, "review_id", "review_id")
    return core.with_(reviews=core.reviews.unionByName(_as_table(acc, core.reviews))), acc, rej


# --------------------------------------------------------------- sequential folds
def _fold(df: DataFrame, key: str, schema: T.StructType, step, init_state, tiebreak=(),
          partitions: int | None = None):
    """Stream rows ordered by (key, seq, *tiebreak) through ``step(state, row)
    -> (state, out_row)``; state resets at every new key via ``init_state``.
    Column names must not start with '_' (they become tuple fields)."""
    parted = df.repartition(partitions, key) if partitions else df.repartition(key)
    ordered = parted.sortWithinPartitions(key, "seq", *tiebreak)
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                if k != last_key:
                    last_key, state = k, init_state(row)
                state, res = step(state, row)
                out.append(res)
            yield pd.DataFrame(out, columns=names)
    return ordered.mapInPandas(run, schema)


def open_rows(history: DataFrame) -> DataFrame:
    """The open (current) history row per employee: effective_end IS NULL."""
    return history.filter(F.col("effective_end").isNull())


def _decide(c: DataFrame, key: str, pre, fold, alone=None) -> DataFrame:
    """``c`` with status and reason: ``pre`` (a built-in rule) rejects what
    needs no history of the batch; a key's only change left is decided by the
    built-in rule ``alone`` (accepted without one); only keys with two or more
    go through ``fold``, which sees no NULL in any column it reads."""
    rid = materialize(c.withColumn("_rid", F.monotonically_increasing_id()).withColumn(REASON, pre))
    left = rid.filter(F.col(REASON).isNull())
    several = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    folded = fold(left.join(several, key, "left_semi").withColumnRenamed("_rid", "rid"))
    st = folded.select(F.col("rid").alias("_rid"), F.col(REASON).alias("_r"))
    st = st.withColumn("_folded", F.lit(True))
    last = F.when(F.col("_folded").isNull(), alone) if alone is not None else F.lit(None).cast("string")
    out = rid.join(st, "_rid", "left").withColumn(REASON, F.coalesce(F.col(REASON), F.col("_r"), last))
    return out.withColumn(STATUS, F.when(F.col(REASON).isNull(), "accepted").otherwise("rejected")).drop("_r", "_folded")


FOLD_OUT = T.StructType([T.StructField("rid", T.LongType()), T.StructField(REASON, T.StringType())])


def _department_status(core: Core, changes: DataFrame) -> DataFrame:
    cur = open_rows(core.history).select("employee_id", F.col("department_id").alias("cur_dept"), F.col("effective_start").alias("cur_start"))
    c = changes.join(cur, "employee_id", "left")
    c = _known(c, "new_department_id", core.departments, "department_id")
    roles = core.job_roles if "new_job_role_id" in changes.columns else None
    if roles is not None:
        c = _known(c, "new_job_role_id", roles, "job_role_id")
    pre = F.coalesce(
        F.when(F.col("cur_dept").isNull(), F.lit("no active job record")),
        F.when(F.col("_no_new_department_id"), F.lit("no such department")),
        F.when(F.col("_no_new_job_role_id"), F.lit("no such role")) if roles is not None else F.lit(None).cast("string"),
        F.when(F.col("effective_date").isNull(), F.lit("effective_date:missing")))

    def step(state, row):
        dept, start = state
        if row.new_department_id == dept:
            return state, (row.rid, "already in that department")
        if row.effective_date <= start:
            return state, (row.rid, "move must be after the current role started")
        return (row.new_department_id, row.effective_date), (row.rid, None)

    def fold(left):
        use = left.select("rid", "seq", "employee_id", "new_department_id", "effective_date", "cur_dept", "cur_start")
        return _fold(use, "employee_id", FOLD_OUT, step, lambda row: (row.cur_dept, row.cur_start), tiebreak=("rid",))

    alone = F.when(F.col("new_department_id") == F.col("cur_dept"), F.lit("already in that department")) \
        .when(F.col("effective_date") <= F.col("cur_start"), F.lit("move must be after the current role started"))
    return _decide(c, "employee_id", pre, fold, alone)


def department_change_status(history: DataFrame, changes: DataFrame, core: Core | None = None) -> DataFrame:
    """Per change: accepted or rejected with the reason."""
    base = core or Core(departments=None, employees=None, history=history, projects=None, reviews=None)
    return _department_status(base, changes).select(*changes.columns, STATUS, REASON)


def apply_department_change(core: Core, changes: DataFrame) -> tuple[Core, DataFrame, DataFrame]:
    """Moves: close the open row the day before, open a new one carrying level
    and income, update the employee's current department and role.  Every
    change comes back as accepted or rejected."""
    full = materialize(_department_status(core, changes))
    acc, rej = _split(full)
    level = open_rows(core.history).select("employee_id", "job_level", "monthly_income")
    # an accepted move starts after the one before it: rows close the day before the next move of the employee
    moves = keyed_lead(acc.select("employee_id", "effective_date", "new_department_id", *[c for c in ("new_job_role_id", "change_reason") if c in acc.columns]),
                       "employee_id", "effective_date", "effective_date", "_next")
    moves = _as_optional(moves, "new_job_role_id", "int")
    moves = _as_optional(moves, "change_reason", "string")
    opened = moves.join(level, "employee_id", "left").select(
        "employee_id", F.col("new_department_id").alias("department_id"), F.col("new_job_role_id").alias("job_role_id"), "job_level",
        "monthly_income", F.col("effective_date").alias("effective_start"), F.date_sub("_next", 1).alias("effective_end"),
        F.coalesce(F.col("change_reason"), F.lit("Department Transfer")).alias("change_reason"))
    first = acc.groupBy("employee_id").agg(F.min("effective_date").alias("_first"))
    hist = core.history.join(first, "employee_id", "left") \
        .withColumn("effective_end", F.when(F.col("effective_end").isNull(), F.date_sub("_first", 1)).otherwise(F.col("effective_end")))
    hist = hist.select(*core.history.columns).unionByName(_as_table(opened, core.history))
    moved = _as_optional(acc, "new_job_role_id", "int")
    last = moved.groupBy("employee_id").agg(F.max_by(F.struct("new_department_id", "new_job_role_id"), "effective_date").alias("_l"))
    emp = core.employees.join(last, "employee_id", "left")
    for col in ("department_id", "job_role_id"):
        if col in core.employees.columns:
            emp = emp.withColumn(col, F.coalesce(F.col(f"_l.new_{col}"), F.col(col)))
    pick = [*changes.columns, STATUS, REASON]
    return core.with_(history=hist, employees=emp.select(*core.employees.columns)), acc.select(*pick), rej.select(*pick)


def _as_optional(df: DataFrame, col: str, kind: str) -> DataFrame:
    return df if col in df.columns else df.withColumn(col, F.lit(None).cast(kind))


def current_allocation(core: Core) -> DataFrame:
    """Open allocation per employee (0 when none)."""
    open_a = core.assignments.filter(F.col("end_date").isNull()) \
        .groupBy("employee_id").agg(F.sum(F.col("allocation_pct").cast("long")).alias("_t"))
    return core.employees.select("employee_id").join(open_a, "employee_id", "left") \
        .select("employee_id", F.coalesce("_t", F.lit(0)).cast("long").alias("total"))


def _assignment_status(core: Core, changes: DataFrame, cap: int) -> DataFrame:
    used = current_allocation(core).withColumnRenamed("total", "used0")
    pairs = core.assignments.select("employee_id", "project_id").distinct().withColumn("_pair", F.lit(True))
    c = _known(_known(changes, "employee_id", core.employees), "project_id", core.projects)
    c = c.join(pairs, ["employee_id", "project_id"], "left").join(used, "employee_id", "left")
    pre = F.coalesce(
        F.when(F.col("_no_employee_id"), F.lit("no such employee")), F.when(F.col("_no_project_id"), F.lit("no such project")),
        F.when(~F.coalesce(F.col("allocation_pct").between(1, 100), F.lit(False)), F.lit("allocation_pct:range")),
        F.when(F.col("_pair"), F.lit("already assigned to that project")),
        # allocations only grow within a batch
        F.when(F.col("used0") + F.col("allocation_pct") > cap, F.lit("allocation over 100%")))

    def step(state, row):
        used_now, taken = state
        if used_now + int(row.allocation_pct) > cap:
            return state, (row.rid, "allocation over 100%")
        if row.project_id in taken:
            return state, (row.rid, "already assigned to that project")
        return (used_now + int(row.allocation_pct), taken | {row.project_id}), (row.rid, None)

    def fold(left):
        use = left.select("rid", "seq", "employee_id", "project_id", "allocation_pct", "used0")
        return _fold(use, "employee_id", FOLD_OUT, step, lambda row: (int(row.used0), frozenset()), tiebreak=("project_id", "rid"))

    return _decide(c, "employee_id", pre, fold)


def assignment_status(core: Core, changes: DataFrame, cap: int = 100) -> DataFrame:
    """Greedy allocation check in arrival order: a change is accepted when
    employee and project exist, the allocation is 1 to 100, the pair is new
    (in the table, even if ended, or accepted earlier in the batch) and used +
    allocation stays within ``cap``; rejected changes consume nothing.  The
    fold's state per employee is the used share and the projects accepted in
    this batch (at most ``cap`` of them)."""
    return _assignment_status(core, changes, cap).select(*changes.columns, STATUS, REASON)


def apply_assignments(core: Core, changes: DataFrame, cap: int = 100) -> tuple[Core, DataFrame, DataFrame]:
    """New assignments under :func:`assignment_status`; accepted and rejected
    changes together are the batch."""
    c = _with_defaults(changes, "project_assignments")
    full = materialize(_assignment_status(core, c, cap))
    acc, rej = _split(full.select(*c.columns, STATUS, REASON))
    return core.with_(assignments=core.assignments.unionByName(_as_table(acc, core.assignments))), acc, rej
