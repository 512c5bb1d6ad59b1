"""Calendar columns."""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ColumnOrName, _c

# Fixed value: the open end of a current version.
OPEN_END = _dt.date(9999, 12, 31)


def open_end() -> Column:
    return F.lit(OPEN_END.isoformat()).cast("date")


def date_key(c: ColumnOrName) -> Column:
    """yyyymmdd as int."""
    d = _c(c)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def with_date_parts(df: DataFrame, date_col: str) -> DataFrame:
    """Adds the 9 calendar attributes (full English day and month names)."""
    d = F.col(date_col)
    return df.select(
        "*",
        date_key(d).alias("date_key"),
        F.dayofmonth(d).cast("int").alias("day_of_month"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.month(d).cast("int").alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).cast("int").alias("quarter_number"),
        F.year(d).cast("int").alias("year_number"),
        F.dayofweek(d).isin(1, 7).cast("int").alias("is_weekend"),
    )


def add_days(c: ColumnOrName, n: int | Column) -> Column:
    return F.date_add(_c(c), n)


def sub_days(c: ColumnOrName, n: int | Column = 1) -> Column:
    return F.date_sub(_c(c), n)


def days_between(end: ColumnOrName, start: ColumnOrName) -> Column:
    return F.datediff(_c(end), _c(start))
