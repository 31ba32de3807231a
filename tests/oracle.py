"""Comparison of a query with its DuckDB SQL."""

import os

import duckdb


def rows(values):
    """Sorted rows as text, floats to nine digits, whole floats as integers."""

    def cell(x):
        if x is None or x != x:
            return "NULL"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else f"{x:.9g}"
        return str(x)

    return sorted(tuple(map(cell, r)) for r in values)


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    got = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(got.columns)
    at = [got.columns.index(n) for n in names]
    want = rows([tuple(r[i] for i in at) for r in got.fetchall()])
    have = rows([tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()])
    assert have == want
