"""Sort, top-k, set operations and surrogate keys."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import global_positions

# Long.MAX_VALUE: hash keys are kept non-negative.
_POSITIVE = 0x7FFFFFFFFFFFFFFF


def order_by(df: DataFrame, *cols: str | Column) -> DataFrame:
    return df.orderBy(*cols)


def top_k(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """ORDER BY .. LIMIT n -> TakeOrderedAndProject (per-task top n, then merge)."""
    return df.orderBy(*order).limit(n)


def any_one(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """LIMIT 1 made deterministic by an explicit order."""
    return df.orderBy(*order).limit(1)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.distinct()


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def hash_key(*cols: str | Column) -> Column:
    """Stable non-negative 64-bit key from business-key columns."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols]).bitwiseAND(F.lit(_POSITIVE))


def assign_keys(new: DataFrame, existing: DataFrame | None, business_key: Sequence[str],
                key_col: str, few: bool = False) -> DataFrame:
    """AUTO_INCREMENT-style keys: rows whose business key is not yet in
    ``existing`` get ``max(existing key) + position`` in business-key order.
    Existing keys are never changed; numbering is distributed (no
    single-partition window).  ``few`` says that the business key has a small
    domain whatever the size of the source (department names, job titles), so
    that a plain window may number the new ones, without sampling or a write."""
    bk = list(business_key)
    fresh = new if existing is None else new.join(existing.select(*bk), bk, "left_anti")
    if few:
        pos = fresh.withColumn("_pos", F.row_number().over(Window.orderBy(*bk)))
    else:
        pos = global_positions(fresh, bk, False, "_pos")
    if existing is None:
        base = F.lit(0).cast("long")
    else:
        # scalar subquery, evaluated once
        base = existing.agg(F.coalesce(F.max(F.when(F.col(key_col) > 0, F.col(key_col))),
                                       F.lit(0)).cast("long")).scalar()
    out = pos
    out = out.withColumn(key_col, (base + F.col("_pos")).cast("long"))
    return out.select(key_col, *new.columns)


def with_unknown(dim: DataFrame, member: dict) -> DataFrame:
    """Add the reserved unknown-member row (values by column name, rest NULL)."""
    row = dim.sparkSession.range(1).select(*[
        (F.lit(member[f.name]) if f.name in member else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in dim.schema.fields])
    return dim.unionByName(row)
