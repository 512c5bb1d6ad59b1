"""Staging files are bound by the names in their headers."""
import datetime as dt

import pytest

from starloom.sources import staging as ST

HEAD = "employee_id,department,job_role,job_level,monthly_income,effective_start,effective_end,change_reason"


def folder(tmp_path, **files):
    d = tmp_path / "stg_employee_history.csv"
    d.mkdir()
    for name, text in files.items():
        (d / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_swapped_columns_in_one_file_and_in_some_files(spark, tmp_path):
    swapped = HEAD.replace("employee_id,", "job_level,", 1).replace("job_role,job_level", "job_role,employee_id")
    base = folder(tmp_path, a=f"{HEAD}\n10,IT,Dev,13,500,2020-01-02,,x\n", b=f"{swapped}\n23,IT,Dev,20,700,2020-03-04,2021-01-01,y\n", empty="")
    df = ST.read_staging(spark, base, "stg_employee_history")
    assert rows(df, "employee_id", "job_level", "monthly_income", "effective_start") == [(10, 13, 500, dt.date(2020, 1, 2)), (20, 23, 700, dt.date(2020, 3, 4))]
    assert df.columns == [*HEAD.split(","), "_corrupt"] and not any(r._corrupt for r in df.collect())


def test_missing_and_repeated_columns_are_named(spark, tmp_path):
    base = folder(tmp_path, a=f"{HEAD}\n", b=HEAD.replace(",monthly_income", "").replace(",change_reason", "") + "\n1,IT,Dev,1,2020-01-02,\n")
    with pytest.raises(ST.HeaderMismatch, match=r"b\.csv: no column monthly_income, change_reason"):
        ST.read_staging(spark, base, "stg_employee_history")
    df = ST.read_staging(spark, base, "stg_employee_history", allow_missing=["monthly_income", "change_reason"])
    assert rows(df, "employee_id", "monthly_income", "change_reason") == [(1, None, None)]
    (tmp_path / "two").mkdir()
    with pytest.raises(ST.HeaderMismatch, match="column job_level repeated"):
        ST.read_staging(spark, folder(tmp_path / "two", a=f"{HEAD},job_level\n"), "stg_employee_history")


def test_extra_columns_are_left_out_or_rescued(spark, tmp_path):
    base = folder(tmp_path, a=f"﻿site, {HEAD},\"a.b c\"\nOslo,1,IT,Dev,2,500,2020-01-02,,x,9\n", b=f"{HEAD}\n2,IT,Dev,2,500,2020-01-02,,x\n")
    assert rows(ST.read_staging(spark, base, "stg_employee_history"), "employee_id", "department", "change_reason") == [(1, "IT", "x"), (2, "IT", "x")]
    got = {r.employee_id: r._rescued for r in ST.read_staging(spark, base, "stg_employee_history", rescue=True).collect()}
    assert got == {1: {"site": "Oslo", "a.b c": "9"}, 2: None}


def test_malformed_rows_keep_their_text_in_any_order(spark, tmp_path):
    reverse = ",".join(HEAD.split(",")[::-1])
    base = folder(tmp_path, a=f"{reverse}\nx,,2020-01-02,500,2,Dev,IT,1\nx,,2020-01-02,oops,2,Dev,IT,2\n")
    df = ST.read_staging(spark, base, "stg_employee_history")
    assert [(r.employee_id, r.monthly_income) for r in df.collect() if not r._corrupt] == [(1, 500)]
    assert [r._corrupt for r in df.collect() if r._corrupt] == ["x,,2020-01-02,oops,2,Dev,IT,2"]


def test_no_file_gives_no_row(spark, tmp_path):
    df = ST.read_staging(spark, folder(tmp_path), "stg_employee_history", rescue=True)
    assert df.count() == 0 and "_rescued" in df.columns
