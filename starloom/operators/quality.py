"""Data-quality constraints as operators.

Each check returns a small report frame ``(constraint, table_name, columns,
n_violations)`` and, where rows can be named, the violating rows.  Reports
are built from partial aggregates, so a check never moves a table whole.
"""
from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_all

REPORT_COLS = ["constraint", "table_name", "columns", "n_violations"]


def _report(df_counts: DataFrame, constraint: str, table: str, columns: str) -> DataFrame:
    return df_counts.select(F.lit(constraint).alias("constraint"), F.lit(table).alias("table_name"),
                            F.lit(columns).alias("columns"), F.col("n").cast("bigint").alias("n_violations"))


def stack_reports(reports: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), list(reports))


def check_not_null(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """NULL count per column in one scan."""
    return check_columns(df, table, cols, ())


def check_columns(df: DataFrame, table: str, not_null: Sequence[str], checks: Sequence[tuple[str, str]]) -> DataFrame:
    """NULL counts and broken CHECK conditions (name, SQL condition; NULL
    passes, as in SQL) of one table in one scan."""
    count = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))
    aggs = [count(F.col(c).isNull()).alias(f"not_null:{c}") for c in not_null]
    aggs += [count(F.coalesce(~F.expr(sql), F.lit(False))).alias(f"check:{name}") for name, sql in checks]
    long = df.agg(*aggs).unpivot([], [a for a in (f"not_null:{c}" for c in not_null)] + [f"check:{n}" for n, _ in checks], "_what", "n")
    return long.select(F.substring_index("_what", ":", 1).alias("constraint"), F.lit(table).alias("table_name"),
                       F.substring_index("_what", ":", -1).alias("columns"), F.col("n").cast("bigint").alias("n_violations"))


def constraint_report(frames: dict[str, DataFrame], rules: dict, parents: dict[str, DataFrame] | None = None, *,
                      skip_keys=(), skip_fks=()) -> DataFrame:
    """One report of all declared constraints (``schemas.Rules``) of
    ``frames``.  Columns a frame does not have are left out.  ``parents``
    gives the tables that foreign keys point to, where they are not
    ``frames`` themselves.  ``skip_keys`` and ``skip_fks`` name (table,
    columns) that a load guarantees by construction."""
    parents = {**frames, **(parents or {})}
    out = []
    for table, df in frames.items():
        r, have = rules[table], set(df.columns)
        cols = [c for c in r.not_null if c in have]
        checks = [(n, sql) for n, c, sql in r.checks if c in have]
        if cols or checks:
            out.append(check_columns(df, table, cols, checks))
        out += [check_unique(df, table, k)[0] for k in r.keys if set(k) <= have and (table, k) not in skip_keys]
        out += [check_fk(df, parents[p], table, [c], [pc])[0] for c, p, pc in r.foreign
                if c in have and p in parents and (table, c) not in skip_fks]
    return stack_reports(out)


def check_unique(df: DataFrame, table: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Duplicate key values (report: how many key values repeat) and all rows
    carrying them.  NULL keys are not compared (as a UNIQUE index)."""
    k = list(keys)
    nonnull = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k]))
    dups = nonnull.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    report = _report(dups.agg(F.count(F.lit(1)).alias("n")), "unique", table, ",".join(k))
    rejects = nonnull.join(dups.select(*k), k, "left_semi")
    return report, rejects


def check_fk(child: DataFrame, parent: DataFrame, table: str, child_cols: Sequence[str],
             parent_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Child rows whose (non-NULL) key has no parent row."""
    cc = list(child_cols)
    pc = list(parent_cols or child_cols)
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(pc, cc)]).distinct()
    nonnull = child.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cc]))
    rejects = nonnull.join(p, cc, "left_anti")
    report = _report(rejects.agg(F.count(F.lit(1)).alias("n")), "foreign_key", table, ",".join(cc))
    return report, rejects


def check_rule(df: DataFrame, table: str, name: str, pred: Column) -> tuple[DataFrame, DataFrame]:
    """CHECK constraint: rows where ``pred`` is false (NULL passes, as in SQL)."""
    rejects = df.filter(~pred)
    return _report(rejects.agg(F.count(F.lit(1)).alias("n")), "check", table, name), rejects


def check_domain(df: DataFrame, table: str, col: str, values: Sequence) -> tuple[DataFrame, DataFrame]:
    rejects = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(list(values)))
    return _report(rejects.agg(F.count(F.lit(1)).alias("n")), "domain", table, col), rejects


# ----------------------------------------------------------- entity rules
# The allowed project statuses, priorities and assignment roles.
PROJECT_STATUSES = ("Active", "On Hold", "Completed")
PROJECT_PRIORITIES = ("Low", "Medium", "High")
ASSIGNMENT_ROLES = ("Contributor", "Lead", "Reviewer")


def _fails(ok: Column) -> Column:
    """A rule fails when it is false or, on NULL, undecided."""
    return ~F.coalesce(ok, F.lit(False))


def _text_reasons(name: str, max_len: int) -> list[Column]:
    v = strip_all(F.coalesce(F.col(name), F.lit("")))
    return [F.when(F.length(v) == 0, F.lit(f"{name}:empty")), F.when(F.length(v) > max_len, F.lit(f"{name}:long"))]


def _range_reason(name: str, lo: int, hi: int) -> Column:
    """Whole part between ``lo`` and ``hi``; NULL fails."""
    return F.when(_fails(F.col(name).cast("int").between(lo, hi)), F.lit(f"{name}:range"))


def _split(df: DataFrame, reasons: list[Column]) -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumn("reject_reasons", F.filter(F.array(*reasons), lambda x: x.isNotNull()))
    valid = tagged.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    rejects = tagged.filter(F.size("reject_reasons") > 0)
    return valid, rejects


def employee_reasons(df: DataFrame) -> list[Column]:
    email = F.lower(strip_all(F.coalesce(F.col("email"), F.lit(""))))
    domain = F.regexp_extract(email, "[^@]*$", 0)
    return (_text_reasons("first_name", 60) + _text_reasons("last_name", 60) + _text_reasons("email", 120)
            + [F.when((F.length(email) > 0) & (~email.contains("@") | ~domain.contains(".")), F.lit("email:form")),
               _range_reason("age", 18, 70), _range_reason("job_level", 1, 5), _range_reason("education_level", 1, 5),
               F.when(_fails(F.col("monthly_income").cast("int") > 0), F.lit("monthly_income:range"))])


def validate_employee(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows (texts stripped, email lower-cased) and rejects with reasons."""
    valid, rejects = _split(df, employee_reasons(df))
    valid = valid.withColumn("first_name", strip_all("first_name")) \
                 .withColumn("last_name", strip_all("last_name")) \
                 .withColumn("email", F.lower(strip_all("email")))
    return valid, rejects


def project_reasons(df: DataFrame) -> list[Column]:
    return (_text_reasons("project_name", 100)
            + [F.when(_fails(F.col("status").isin(*PROJECT_STATUSES)), F.lit("status:domain")),
               F.when(_fails(F.col("priority").isin(*PROJECT_PRIORITIES)), F.lit("priority:domain")),
               F.when(F.col("start_date").isNull(), F.lit("start_date:missing")),
               F.when(F.col("end_date") < F.col("start_date"), F.lit("end_date:order")),
               F.when(_fails(F.col("budget") >= 0), F.lit("budget:range"))])


def validate_project(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid, rejects = _split(df, project_reasons(df))
    return valid.withColumn("project_name", strip_all("project_name")), rejects


def review_reasons(df: DataFrame) -> list[Column]:
    scores = [_range_reason(c, 1, 4) for c in ("performance_rating", "job_satisfaction", "environment_satisfaction", "work_life_balance")]
    return scores + [_range_reason("percent_salary_hike", 0, 50)]


def validate_review(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, review_reasons(df))


def reasons_column(reasons: list[Column]) -> Column:
    """All failing reasons in rule order as one '; '-joined string ('' = valid)."""
    return F.concat_ws("; ", *reasons)
