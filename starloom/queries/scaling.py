"""Scaling queries."""
from __future__ import annotations

from ..plans import scale as SC
from ..registry import query
from ..sources.fixtures import Fixture


def _h(expr: str, salt: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', CAST({expr} AS VARCHAR), '{salt}')), 1, 8)) AS BIGINT)"


@query("close_intervals", """
SELECT employee_id, effective_start,
       CAST(lead(effective_start) OVER (PARTITION BY employee_id ORDER BY effective_start) - INTERVAL 1 DAY AS DATE) effective_end
FROM fx_history""")
def close_intervals(spark, sf):
    h = Fixture(spark, sf).history().select("employee_id", "effective_start")
    return SC.close_intervals(h, "employee_id", "effective_start")


@query("sample_fraction", f"SELECT review_id, employee_id FROM fx_review WHERE {_h('review_id', 'sample')} < 429496730")
def sample_fraction(spark, sf):
    r = Fixture(spark, sf).review().select("review_id", "employee_id")
    return SC.sample_fraction(r, "review_id", 0.10)


COLS = ["age", "distance_from_home", "monthly_income", "total_working_years", "years_at_company"]


@query("bootstrap_scale_up", f"""
, b AS (SELECT employee_id, {', '.join(COLS)}, row_number() OVER (ORDER BY employee_id) - 1 idx FROM fx_stg_employee),
n AS (SELECT count(*) n FROM b),
slots AS (SELECT (SELECT n FROM n) + b.idx * 2 + j - 1 new FROM b, range(1, 3) t(j)),
cl AS (SELECT s.new, b.employee_id src_id, b.* EXCLUDE (employee_id, idx),
              greatest(least(b.age + {_h('s.new', 'scale|age')} % 7 - 3, 60), 18) age2,
              greatest(least(b.distance_from_home + {_h('s.new', 'scale|distance')} % 5 - 2, 29), 1) dist2,
              greatest((CAST(b.monthly_income AS BIGINT) * (9000 + {_h('s.new', 'scale|income')} % 2001) * 2 + 10000) // 20000, 1009) inc2,
              {_h('s.new', 'scale|total')} % 3 ht, {_h('s.new', 'scale|years')} % 3 hy
       FROM slots s JOIN b ON b.idx = {_h('s.new', 'scale|pick')} % (SELECT n FROM n)),
cl2 AS (SELECT *, least(greatest(total_working_years + ht - 1, 0), age2 - 16) tot2 FROM cl)
SELECT CAST(1001 + idx AS BIGINT) employee_id, employee_id source_employee_id, {', '.join(COLS)} FROM b
UNION ALL
SELECT CAST(1001 + new AS BIGINT), src_id, CAST(age2 AS INT), CAST(dist2 AS INT), CAST(inc2 AS INT), CAST(tot2 AS INT),
       CAST(least(greatest(years_at_company + hy - 1, 0), tot2) AS INT) FROM cl2""")
def bootstrap_scale_up(spark, sf):
    """The staging snapshot bootstrapped to three times its size."""
    base = Fixture(spark, sf).stg_employee().select("employee_id", *COLS)
    out = SC.scale_up(base, "employee_id", 3)
    return out.select("employee_id", "source_employee_id", *COLS)

