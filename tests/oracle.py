"""Rows of a DuckDB query over the tables of a folder, and comparable rows of both engines."""

import datetime
import decimal
import glob
import os

import duckdb


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.sql(sql)
    return list(got.columns), got.fetchall()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def same(df, sql, folder):
    columns, want = oracle_rows(sql, folder)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
    at = [columns.index(c) for c in order]
    assert got == sorted(str([plain(r[k]) for k in at]) for r in want)
    return len(got)
