"""Text cleaning and labelling columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: ColumnOrName) -> Column:
    """SQL-path cleaning: strip leading/trailing spaces only (like SQL TRIM)."""
    return F.trim(_c(c))


def strip_all(c: ColumnOrName) -> Column:
    """Entity-path cleaning: strip every kind of surrounding whitespace."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def clean_email(c: ColumnOrName) -> Column:
    return F.lower(F.trim(_c(c)))


def yes_no(c: ColumnOrName, case_insensitive: bool = False) -> Column:
    """'Yes' -> 1, anything else -> 0 (NULL stays NULL)."""
    v = F.trim(_c(c))
    if case_insensitive:
        v = F.lower(v)
        return (v == F.lit("yes")).cast("int")
    return (v == F.lit("Yes")).cast("int")


def full_name(first: ColumnOrName, last: ColumnOrName) -> Column:
    """first + ' ' + last; NULL when either part is NULL (SQL CONCAT)."""
    return F.concat(_c(first), F.lit(" "), _c(last))


def slug_email(first: ColumnOrName, last: ColumnOrName, emp_id: ColumnOrName,
               domain: str = "corp.example") -> Column:
    """first.last.<id>@domain with everything but [a-z0-9.] removed."""
    def slug(x: Column) -> Column:
        return F.regexp_replace(F.lower(x), "[^a-z0-9.]", "")
    return F.concat(slug(_c(first)), F.lit("."), slug(_c(last)), F.lit("."), _c(emp_id).cast("string"),
                    F.lit("@" + domain))


def flag_label(c: ColumnOrName, yes: str, no: str) -> Column:
    return F.when(_c(c) == 1, F.lit(yes)).otherwise(F.lit(no))
