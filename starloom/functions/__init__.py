"""Column-level helpers; every one is a built-in Spark expression (no UDF)."""
from .text import clean_text, strip_all, clean_email, yes_no, full_name, slug_email, flag_label  # noqa: F401
from .dates import (date_key, with_date_parts, add_days, sub_days, days_between,  # noqa: F401
                    open_end, OPEN_END)
from .numeric import (round_half_up, or_default, as_int, clip, review_score, decode)  # noqa: F401
