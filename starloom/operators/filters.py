"""Row filters.  All are plain Catalyst predicates, so they reach the scan."""
from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def neq(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) != F.lit(value))


def between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.filter(F.col(col).between(lo, hi))


def is_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def is_open(df: DataFrame, end_col: str) -> DataFrame:
    """Rows whose validity interval has no end yet."""
    return df.filter(F.col(end_col).isNull())


def maybe_keys(df: DataFrame, key_col: str, keys=None) -> DataFrame:
    """``keys is None`` means all rows; a scalar filters one key; a DataFrame
    of keys filters by semi join (the set-based form of ``p IS NULL OR k = p``)."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key_col).distinct(), key_col, "left_semi")
    if isinstance(keys, (list, tuple, set)):
        return df.filter(F.col(key_col).isin(list(keys)))
    return df.filter(F.col(key_col) == F.lit(keys))


def changed(old_prefix_cols: Sequence[tuple[Column, Column]]) -> Column:
    """True when any pair differs; NULL-safe (a NULL on one side counts)."""
    return reduce(lambda a, b: a | b, [~a.eqNullSafe(b) for a, b in old_prefix_cols])


def groups_having(df: DataFrame, keys: Sequence[str], min_count: int,
                  strict: bool = False, count_col: str = "n") -> DataFrame:
    """Groups with COUNT(*) >= min_count (``strict``: > min_count)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    cond = F.col(count_col) > min_count if strict else F.col(count_col) >= min_count
    return g.filter(cond)


def where_key_is(df: DataFrame, key_col: str, scalar: DataFrame) -> DataFrame:
    """``key = (SELECT k FROM scalar ORDER BY k LIMIT 1)`` as a semi join with the
    (at most) one-row frame; deterministic because the one row is the minimum."""
    one = scalar.select(F.min(scalar.columns[0]).alias(key_col))
    return df.join(one, key_col, "left_semi")


def existing(batch: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch rows whose key already exists in ``table`` (set-based probe)."""
    return batch.join(table.select(*keys), list(keys), "left_semi")
