"""Registered queries against their DuckDB oracle on the smallest fixture."""
import math
import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

SAMPLE = ["yearly_trend", "kpis", "top_performers", "attrition_risk_list", "project_bottlenecks",
          "scd2_refresh", "fact_reviews_incremental", "dim_date", "dim_project_scd1", "join_asof_window",
          "win_rank_global", "key_surrogate", "validate_employee", "dq_foreign_key", "load_employees",
          "apply_assignments", "apply_department_change", "bootstrap_scale_up", "stream_scd2_apply",
          "join_point_in_time_first", "fact_rekey", "scd2_refresh_keys", "load_employees_ci", "dq_not_null", "agg_scalar_bundle", "proj_round"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v.__class__.__name__ == "Decimal":
        return round(float(v), 6)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_warehouse_query_has_an_oracle():
    corpus = {q for q in E.queries() if q == "pipeline" or re.match(r"op\d+_", q)}
    assert set(E.queries()) - corpus == set(E.oracle_sql()) - corpus


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["review_year", "department_name", "avg_score", "avg_rating", "reviews", "yoy_change"]
    assert df.count() > 0
