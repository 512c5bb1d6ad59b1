"""Window operators.

``first_per``/``latest_per`` filter a ranking function, which Catalyst turns into a partial WindowGroupLimit before the shuffle (each map
task keeps only its own top rows per key) and a final one after it.
"""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per key by ``order`` (make it total for determinism)."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_per(df: DataFrame, key: str, order_col: str) -> DataFrame:
    return first_per(df, [key], [F.col(order_col).desc()])


def with_next(df: DataFrame, key: str, order: str, col: str, alias: str = "next_start") -> DataFrame:
    """``lead(col)`` per key (skew-splitting, see :func:`keyed_lead`)."""
    return keyed_lead(df, key, order, col, alias)


def with_delta(df: DataFrame, key: str, order: str, col: str, dp: int,
               alias: str = "delta") -> DataFrame:
    """value - previous value of the same key (on unrounded inputs), rounded;
    the previous value is a skew-splitting ``lag``."""
    prev = keyed_lead(df, key, order, col, "_prev", descending=True)
    return prev.withColumn(alias, F.round(F.col(col) - F.col("_prev"), dp)).drop("_prev")


def top_ranks(df: DataFrame, key: str, order: Sequence[str], n: int, alias: str = "rank", descending=False, salts: int = 16) -> DataFrame:
    """Dense rank per key, up to ``n``; ties share a rank, so more than n rows
    may pass.

    The n first distinct values of each key are selected apart from the rows:
    distinct by partial aggregates, cut to n per (key, salt), merged to n per
    key.  The rows then meet that short list by an equi-join on key and
    values, so no task ever sorts, or even holds, a key's rows."""
    o = _sort_cols(order, descending)
    values = df.select(key, *order).distinct().withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = values.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_s").orderBy(*o))).filter(F.col("_r") <= n)
    best = part.withColumn(alias, F.row_number().over(Window.partitionBy(key).orderBy(*o))).filter(F.col(alias) <= n)
    best = best.select(*[F.col(c).alias(f"_o_{c}") for c in (key, *order)], alias)
    same = reduce(lambda x, y: x & y, [df[c].eqNullSafe(best[f"_o_{c}"]) for c in (key, *order)])
    return df.join(best, same).select(*[df[c] for c in df.columns], alias)


def _sort_cols(order: Sequence[str], descending) -> list[Column]:
    if isinstance(descending, bool):
        descending = [descending] * len(order)
    return [F.col(c).desc() if d else F.col(c).asc() for c, d in zip(order, descending)]


def global_positions(df: DataFrame, order: Sequence[str], descending=False,
                     alias: str = "_pos", partitions: int | None = None) -> DataFrame:
    """1-based position of every row in the total order, computed without a
    single-partition window.

    The frame is range-partitioned on the order columns and sorted inside each
    partition; ``monotonically_increasing_id`` then carries (partition, row)
    and the per-partition counts -- one row per partition -- give each
    partition its offset.  The tagged rows are written once (shared
    checkpoint folder), so the counts and the rows agree even when the input
    is recomputed in another order.  Give a total order (add a unique
    tie-break column) when positions must be reproducible run to run.
    """
    from ..session import materialize
    oc = _sort_cols(order, descending)
    # no explicit count: AQE may coalesce the range partitions of a small input
    ranged = (df.repartitionByRange(partitions, *oc) if partitions else df.repartitionByRange(*oc)) \
        .sortWithinPartitions(*oc)
    # written once so the counts and the rows come from the same partitioning
    tagged = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id())
                         .withColumn("_pid", F.shiftright("_mid", 33))
                         .withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), 33) + 1))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: bounded by the partition count
    offsets = counts.select(
        "_pid", F.coalesce(F.sum("_cnt").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    pos = tagged.join(F.broadcast(offsets), "_pid")
    return pos.withColumn(alias, F.col("_off") + F.col("_local")).drop("_mid", "_pid", "_local", "_off")


def with_rank(df: DataFrame, order: Sequence[str], descending=False,
              alias: str = "rank", few_values: bool = False) -> DataFrame:
    """SQL RANK() over the whole frame, as bigint: 1 + the rows before the
    value.  Rows are counted per distinct value (partial aggregates), the
    counts are summed up along the order and joined back, so no tie group
    ever meets in one task.  ``few_values`` says that the order columns have
    a small domain whatever the size of the frame (rounded scores), so that
    the running total may be a plain window over the distinct values."""
    counts = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    oc = _sort_cols(order, descending)
    if few_values:
        w = Window.orderBy(*oc).rowsBetween(Window.unboundedPreceding, -1)
        before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    else:
        before = running_total(counts, oc, "_n", "_before")
    b = before.select(*[F.col(c).alias(f"_o_{c}") for c in order], "_before")
    same = reduce(lambda x, y: x & y, [df[c].eqNullSafe(b[f"_o_{c}"]) for c in order])
    return df.join(b, same).select((F.col("_before") + 1).cast("bigint").alias(alias), *[df[c] for c in df.columns])


def running_total(df: DataFrame, order: Sequence[Column], col: str, alias: str) -> DataFrame:
    """Sum of ``col`` over all rows before each row: range-partitioned, summed
    inside each partition, plus the partitions' own totals (one row each)."""
    from ..session import materialize
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    t = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_mid", 33)))
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = t.groupBy("_pid").agg(F.sum(col).alias("_t")).select("_pid", F.coalesce(F.sum("_t").over(along), F.lit(0)).alias("_off"))
    total = F.coalesce(F.sum(col).over(inside), F.lit(0)) + F.col("_off")
    return t.join(F.broadcast(offsets), "_pid").withColumn(alias, total).drop("_mid", "_pid", "_off")


def keyed_lead(df: DataFrame, key: str, order: str, col: str, alias: str, descending: bool = False) -> DataFrame:
    """``lead(col) OVER (PARTITION BY key ORDER BY order)`` (``lag`` if
    ``descending``); (key, order) should be unique, as for any lead.

    On a date order a hot key is split: the lead is taken inside each (key,
    year), and a year's last row takes the first value of the key's next year
    from a table of one row per (key, year).  No sampling, no write, and one
    shuffle of the rows.  Other orders (years, positions of small aggregated
    frames) take the plain window."""
    o = F.col(order).desc() if descending else F.col(order).asc()
    if df.schema[order].dataType.typeName() not in ("date", "timestamp", "timestamp_ntz"):
        return df.withColumn(alias, F.lead(col).over(Window.partitionBy(key).orderBy(o)))
    year = F.coalesce(F.year(order), F.lit(-1))
    inside = Window.partitionBy(key, "_y").orderBy(o)
    t = (df.withColumn("_y", year).withColumn("_more", F.lead(F.lit(True)).over(inside))
         .withColumn("_in", F.lead(col).over(inside)))
    end = (F.max if descending else F.min)(F.struct(F.col(order).alias("o"), F.col(col).alias("v")))
    heads = df.groupBy(F.col(key).alias("_k"), year.alias("_hy")).agg(end.alias("_h"))
    along = Window.partitionBy("_k").orderBy(F.col("_hy").desc() if descending else F.col("_hy"))
    heads = heads.withColumn("_next", F.lead("_h").over(along)).select("_k", "_hy", F.col("_next.v").alias("_out"))
    j = t.join(heads, t[key].eqNullSafe(heads["_k"]) & (t["_y"] == heads["_hy"]), "left")
    value = F.when(F.col("_more"), F.col("_in")).otherwise(F.col("_out"))
    return j.withColumn(alias, value).drop("_y", "_more", "_in", "_k", "_hy", "_out")
