"""Row-count audit of several table states as one small report."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit(tables: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """(layer, label, n): one global count per table, stacked (each count is a
    partial aggregate, so no table is moved whole)."""
    out = None
    for layer, label, df in tables:
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(layer).alias("layer"), F.lit(label).alias("label"), "n")
        out = c if out is None else out.unionByName(c)
    return out
