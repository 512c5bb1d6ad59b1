"""Aggregates.  All are algebraic, so Spark combines them map-side before
the shuffle and a hot group key never reaches one task unreduced."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_rows(df: DataFrame, keys: Sequence[str] = (), alias: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def sum_or_zero(df: DataFrame, keys: Sequence[str], col: str, alias: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.col(col).cast("bigint")), F.lit(0)).cast("bigint").alias(alias))


def avg_exact_col(col: str | Column, dp: int) -> Column:
    """AVG over an exact decimal, rounded half-up, returned as double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.avg(c), dp).cast("double")


def avg_int_col(col: str | Column, dp: int) -> Column:
    """AVG of an int as an exact decimal (not a double), rounded half-up."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.avg(c.cast("decimal(10,0)")), dp).cast("double")


def pct_where_col(pred: Column, dp: int = 1) -> Column:
    """100 * share of rows meeting ``pred``, exact, rounded half-up."""
    return F.round(F.avg(pred.cast("int").cast("decimal(10,0)")) * 100, dp).cast("double")


def avg_exact(df: DataFrame, keys: Sequence[str], col: str, dp: int, alias: str) -> DataFrame:
    return df.groupBy(*keys).agg(avg_exact_col(col, dp).alias(alias))


def pct_where(df: DataFrame, keys: Sequence[str], pred: Column, dp: int, alias: str) -> DataFrame:
    return df.groupBy(*keys).agg(pct_where_col(pred, dp).alias(alias))


def count_distinct(df: DataFrame, keys: Sequence[str], col: str, alias: str,
                   approx: bool = False) -> DataFrame:
    """Distinct values per group; ``approx`` estimates them from a sketch of
    fixed size per group (standard error ``SKETCH_ERROR``)."""
    if approx:
        return distinct_estimate(distinct_sketches(df, keys, col, "_sketch"), keys, "_sketch", alias)
    return df.groupBy(*keys).agg(F.count_distinct(col).cast("bigint").alias(alias))


#: Sketches hold 2^SKETCH_LG registers.
SKETCH_LG = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG / 2)


def distinct_sketches(df: DataFrame, keys: Sequence[str], col: str, alias: str) -> DataFrame:
    """A HyperLogLog sketch of the values of each group, to be stored: sketches
    of any split of the rows unite to that of all rows."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(col), SKETCH_LG).alias(alias))


def distinct_estimate(sketches: DataFrame, keys: Sequence[str], col: str, alias: str) -> DataFrame:
    """Estimated distinct values per group of stored sketches, united here."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(col)).cast("bigint").alias(alias))


def group_agg(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def distinct_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine several one-row aggregates into a single row without a cross
    join: stack them (missing columns NULL) and take the non-NULL value."""
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    cols = []
    for f in frames:
        cols += f.columns
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


def count_groups(df: DataFrame, keys: Sequence[str], min_count: int, strict: bool = True,
                 alias: str = "n_groups") -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    g = g.filter(F.col("_n") > min_count if strict else F.col("_n") >= min_count)
    return g.agg(F.count(F.lit(1)).alias(alias))
