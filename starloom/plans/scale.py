"""Dataset scaling and interval helpers (deterministic, oracle-checkable)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def close_intervals(df: DataFrame, key: str, start: str, end: str = "effective_end") -> DataFrame:
    """``end`` = next start of the same key - 1 day; NULL for the last one
    (skew-splitting lead, see operators.windows.keyed_lead)."""
    from ..operators.windows import keyed_lead
    return keyed_lead(df, key, start, start, "_next_start") \
        .withColumn(end, F.date_sub("_next_start", 1)).drop("_next_start")


def hash_int(*parts, salt: str) -> "F.Column":
    """Deterministic non-negative int from the first 32 bits of an md5 (the
    same number in any SQL engine that has md5)."""
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    h = F.md5(F.concat_ws("|", *cols, F.lit(salt)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def sample_fraction(df: DataFrame, key: str, fraction: float, salt: str = "sample") -> DataFrame:
    """Deterministic Bernoulli sample: a row is kept when its key hashes below
    the fraction of the 32-bit range (same rows on every run and on every
    engine; the fraction is exact to 2**-32)."""
    return df.filter(hash_int(key, salt=salt) < int(round(fraction * 2 ** 32)))


def scale_up(base: DataFrame, key: str, factor: int, salt: str = "scale", first_id: int = 1001) -> DataFrame:
    """Bootstrap a base extract to ``factor`` times its size.

    Base rows are kept unchanged; every base row opens ``factor - 1`` clone
    slots and each slot copies a base row picked by hash (sampling with
    replacement), then jitters the numeric columns and re-clips them, keeping
    years_at_company <= total_working_years <= age - 16.  New ids are
    ``first_id + position``: base rows first (by ``key``), clones after.
    Everything is distributed: positions come from range partitioning and the
    base count is a scalar subquery.
    """
    from ..operators.windows import global_positions
    pos = global_positions(base, [key], False, "_pos").withColumn("_idx", F.col("_pos") - 1).drop("_pos")
    n = base.agg(F.count(F.lit(1)).cast("long")).scalar()
    originals = pos.select(F.col("_idx").alias("_new"), F.col(key).alias("source_" + key), *base.columns)
    slots = pos.select("_idx", F.explode(F.sequence(F.lit(1), F.lit(max(factor - 1, 0)))).alias("_j")) \
        .filter(F.lit(factor) > 1)
    slots = slots.select((n + F.col("_idx") * (factor - 1) + F.col("_j") - 1).alias("_new"))
    slots = slots.withColumn("_src", hash_int("_new", salt=salt + "|pick") % n)
    src = pos.withColumnRenamed("_idx", "_src")
    clones = slots.join(src, "_src", "inner")

    def h(col: str, m: int):
        return hash_int("_new", salt=f"{salt}|{col}") % m

    age = F.greatest(F.least(F.col("age") + h("age", 7) - 3, F.lit(60)), F.lit(18))
    dist = F.greatest(F.least(F.col("distance_from_home") + h("distance", 5) - 2, F.lit(29)), F.lit(1))
    inc = F.greatest(F.floor((F.col("monthly_income").cast("long") * (9000 + h("income", 2001)) * 2 + 10000) / 20000),
                     F.lit(1009))
    clones = clones.withColumn("age", age.cast("int")).withColumn("distance_from_home", dist.cast("int")) \
        .withColumn("monthly_income", inc.cast("int"))
    total = F.least(F.greatest(F.col("total_working_years") + h("total", 3) - 1, F.lit(0)), F.col("age") - 16)
    clones = clones.withColumn("total_working_years", total.cast("int"))
    years = F.least(F.greatest(F.col("years_at_company") + h("years", 3) - 1, F.lit(0)), F.col("total_working_years"))
    clones = clones.withColumn("years_at_company", years.cast("int"))
    clones = clones.select("_new", F.col(key).alias("source_" + key), *base.columns)
    out = originals.unionByName(clones)
    return out.withColumn(key, (F.lit(first_id) + F.col("_new")).cast("long")).drop("_new")
