"""Joins.

An explicit broadcast hint is only given through :func:`bounded_broadcast`
when a row bound is known or proven; otherwise Spark's size-checked
automatic broadcast and AQE decide (sort-merge beyond the threshold, skewed
partitions split at run time).  Range joins are bucketed by time (:func:`asof`,
:func:`first_covering`) so no key emits all its pairs.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def bounded_broadcast(df: DataFrame, known_rows: int | None = None) -> DataFrame:
    """Broadcast only with a size bound.

    ``known_rows`` is a bound by construction (days in a calendar).  Without
    one there is no hint: the planner broadcasts a side whose estimated size
    is under ``spark.sql.autoBroadcastJoinThreshold``, AQE re-checks the real
    size after each shuffle, and beyond it the join stays a sort-merge join.
    """
    return df if known_rows is None else F.broadcast(df)


def _on(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def lookup(df: DataFrame, lkp: DataFrame, left_on: str | Column, right_on: str,
           take: Sequence[str]) -> DataFrame:
    """Resolve a text/business key to lookup columns; unmatched rows drop out."""
    small = bounded_broadcast(lkp.select(F.col(right_on).alias("_lk_key"), *take))
    lc = F.col(left_on) if isinstance(left_on, str) else left_on
    return df.join(small, lc == F.col("_lk_key"), "inner").drop("_lk_key")


def star(fact: DataFrame, dims: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Fact to dimensions on surrogate keys (inner)."""
    out = fact
    for dim, key in dims:
        out = out.join(dim, key, "inner")
    return out


def drop_orphans(child: DataFrame, parent: DataFrame, keys) -> DataFrame:
    """Keep child rows whose key exists in parent (parent key unique)."""
    k = _on(keys)
    return child.join(parent.select(*k), k, "left_semi")


only_in = drop_orphans


def not_in(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Anti join: rows of df whose key is absent from other."""
    k = _on(keys)
    return df.join(other.select(*k), k, "left_anti")


def lookup_or(df: DataFrame, lkp: DataFrame, on: str, key_col: str, default=-1,
              take: Sequence[str] = ()) -> DataFrame:
    """Optional dimension: left join, missing key becomes ``default``."""
    right = lkp.select(F.col(on).alias("_lk_on"), F.col(key_col).alias("_lk_key"), *take)
    j = df.join(right, df[on] == right["_lk_on"], "left")
    return j.withColumn(key_col, F.coalesce(F.col("_lk_key"), F.lit(default))).drop("_lk_on", "_lk_key")


def asof(events: DataFrame, versions: DataFrame, key: str, at: str,
         start: str = "start_date", end: str = "end_date", bucket_by_year: bool = True,
         bounds_from: DataFrame | None = None) -> DataFrame:
    """Each event with the version valid on its date (inner: events outside
    every version drop out).

    Bucketed interval join: every version is repeated for each calendar year
    it overlaps (capped to the events' year range, read as two scalar
    subqueries) and the join key is (key, year) plus the date residual.  An
    event is compared only with the versions overlapping its own year --
    not with every version of its key -- and a hot key is spread over its
    years (AQE can still split a hot (key, year) partition)."""
    if not bucket_by_year:
        v = versions.withColumnRenamed(key, "_v_key")
        j = events.join(v, (events[key] == v["_v_key"]) & events[at].between(v[start], v[end]), "inner")
        return j.drop("_v_key")
    # ``bounds_from``: a cheaper frame covering the events' dates (the raw
    # input before de-duplication), so the events' own plan is not run twice
    src = bounds_from if bounds_from is not None else events
    yrs = src.agg(F.min(F.year(at)).alias("lo"), F.max(F.year(at)).alias("hi"))
    lo, hi = yrs.select("lo").scalar(), yrs.select("hi").scalar()
    y0 = F.greatest(F.year(start), lo)
    y1 = F.least(F.year(end), hi)
    years = F.when(y0 <= y1, F.sequence(y0, y1)).otherwise(F.array().cast("array<int>"))
    v = versions.withColumnRenamed(key, "_v_key").withColumn("_v_year", F.explode(years))
    e = events.withColumn("_e_year", F.year(at))
    cond = (e[key] == v["_v_key"]) & (e["_e_year"] == v["_v_year"]) & e[at].between(v[start], v[end])
    return e.join(v, cond, "inner").drop("_v_key", "_v_year", "_e_year")


def asof_parts(events: DataFrame, versions: DataFrame, key: str, at: str, start: str = "start_date",
               version_cols: Sequence[str] | None = None) -> DataFrame:
    """Versions (kind 0) and events (kind 1) in one table, range-partitioned
    and sorted on (key, date, kind); ``_pid`` numbers the partitions in that
    order.  Events of one key and day are told apart by a number, so that
    even a hot day is split.  Written once: partitions are then fixed."""
    from ..session import materialize
    vcols = list(version_cols or [c for c in versions.columns if c != key])
    version = versions.select(F.struct(*vcols).alias("_v")).schema["_v"].dataType
    event = events.select(F.struct(*events.columns).alias("_e")).schema["_e"].dataType
    ver = versions.select(F.col(key).alias("_k"), F.col(start).alias("_d"), F.lit(0).alias("_kind"), F.struct(*vcols).alias("_v"), F.lit(None).cast(event).alias("_e"))
    evt = events.select(F.col(key).alias("_k"), F.col(at).alias("_d"), F.lit(1).alias("_kind"), F.lit(None).cast(version).alias("_v"), F.struct(*events.columns).alias("_e"))
    both = ver.unionByName(evt).filter("_k is not null and _d is not null").withColumn("_n", F.monotonically_increasing_id())
    order = ["_k", "_d", "_kind", "_n"]
    return materialize(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()))


def asof_window(events: DataFrame, versions: DataFrame, key: str, at: str,
                start: str = "start_date", end: str = "end_date",
                version_cols: Sequence[str] | None = None) -> DataFrame:
    """Same result as :func:`asof` without a range join: a segmented prefix
    scan.  Versions and events are range-partitioned together on (key, date),
    so a hot key spans as many partitions as its rows need; inside a partition
    each event takes the key's last version started on or before its date.  One row
    per partition, its last version, is scanned along the partitions, and
    gives events ahead of their key's first version in a partition the one
    from before it.  A version counts only while it has not ended."""
    vcols = list(version_cols or [c for c in versions.columns if c != key])
    ev_cols = list(events.columns)
    t = asof_parts(events, versions, key, at, start, vcols)
    inside = Window.partitionBy("_pid", "_k").orderBy("_d", "_kind", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = F.max_by(F.struct("_k", "_v"), F.when(F.col("_kind") == 0, F.struct("_k", "_d", "_n")))
    tails = t.groupBy("_pid").agg(tail.alias("_tail"), F.count(F.when(F.col("_kind") == 0, 1)).alias("_has"))
    along = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("_pid", F.last(F.when(F.col("_has") > 0, F.col("_tail")), ignorenulls=True).over(along).alias("_before"))
    scanned = t.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).filter(F.col("_kind") == 1)
    hit = scanned.join(F.broadcast(carried), "_pid")  # one row per partition
    hit = hit.withColumn("_cur", F.coalesce("_in", F.when(F.col("_before._k") == F.col("_k"), F.col("_before._v"))))
    hit = hit.filter(F.col("_cur").isNotNull() & (F.col("_d") <= F.col(f"_cur.{end}")))
    return hit.select(*[F.col(f"_e.{c}").alias(c) for c in ev_cols],
                      *[F.col(f"_cur.{c}").alias(c) for c in vcols if c not in ev_cols])


def numbers(spark: SparkSession, n: int, col: str = "n") -> DataFrame:
    """0 .. n-1 (replaces a cross join of digit tables)."""
    return spark.range(n).select(F.col("id").alias(col))


def overwrite(target: DataFrame, source: DataFrame, keys, cols: Sequence[str],
              only_changed: bool = False) -> DataFrame:
    """UPDATE target JOIN source SET cols: matched rows take source values
    (NULLs included), unmatched target rows stay as they are."""
    k = _on(keys)
    s = source.select(*k, *[F.col(c).alias(f"_src_{c}") for c in cols], F.lit(True).alias("_m"))
    j = target.join(s, k, "left")
    out = j.select(*[
        (F.when(F.col("_m"), F.col(f"_src_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c))
        for c in target.columns])
    return out


def first_covering(events: DataFrame, intervals: DataFrame, key: str, at: str,
                   event_id: str, seq: str, value: str, start: str = "start_date",
                   end: str = "end_date") -> DataFrame:
    """For each event, ``value`` of the first interval (by ``seq``, then by
    ``value``) of the same key that covers the event date (open end
    allowed); NULL when none.

    Calendar months are buckets.  An interval that covers a whole month
    enters that month's minimum (intervals without an end as a running
    minimum over the key's months); only intervals that begin or end inside a
    month meet that month's events, by an equi-join with a date residual.  The
    answer is the least of the three, so work follows events and intervals,
    never their pairs, and a hot key is spread over its months.  Intervals
    without a start cover nothing."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    iv = intervals.filter(F.col(start).isNotNull()).select(
        F.col(key).alias("_k"), F.col(start).alias("_s"),
        (F.col(end) if end in intervals.columns else F.lit(None).cast("date")).alias("_e"),
        F.struct(F.col(seq).alias("s"), F.col(value).alias("v")).alias("_v"))
    ev = events.select(F.col(event_id).alias("_id"), F.col(key).alias("_k"), F.col(at).alias("_d"), month(at).alias("_m"))
    closed, open_ = iv.filter("_e is not null"), iv.filter("_e is null")

    inner = F.when(month("_e") - month("_s") > 1, F.sequence(month("_s") + 1, month("_e") - 1))
    whole = closed.select("_k", F.explode(inner).alias("_m"), "_v").groupBy("_k", "_m").agg(F.min("_v").alias("_whole"))
    since = open_.select("_k", (month("_s") + 1).alias("_m"), "_v").groupBy("_k", "_m").agg(F.min("_v").alias("_v"))
    asked = ev.select("_k", "_m").distinct().withColumn("_v", F.lit(None).cast(since.schema["_v"].dataType))
    run = Window.partitionBy("_k").orderBy("_m").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    open_min = since.unionByName(asked).withColumn("_open", F.min("_v").over(run)) \
        .groupBy("_k", "_m").agg(F.min("_open").alias("_open"))
    ends = closed.filter(month("_e") != month("_s")).select("_k", month("_e").alias("_m"), "_s", "_e", "_v")
    part = iv.select("_k", month("_s").alias("_m"), "_s", "_e", "_v").unionByName(ends)
    hit = (ev.join(part, ["_k", "_m"]).filter((F.col("_d") >= F.col("_s")) & (F.col("_e").isNull() | (F.col("_d") <= F.col("_e"))))
           .groupBy("_id").agg(F.min("_v").alias("_part")))
    best = (ev.join(whole, ["_k", "_m"], "left").join(open_min, ["_k", "_m"], "left").join(hit, "_id", "left")
            .select("_id", F.least("_whole", "_open", "_part")["v"].alias("_first_value")))
    kept = events if value not in events.columns else events.drop(value)
    return kept.join(best, kept[event_id] == best["_id"], "left").drop("_id").withColumnRenamed("_first_value", value)
