"""Compares a query with its oracle SQL: kinds of values, exact values exactly, floats to nine digits."""

import math

import duckdb

from millrace.session import TABLES

SF = "/root/testdata/sf0.001"


def _key(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    # exact columns first, so that a float at the edge of its rounding can't change the order
    exact = [i for i in order if not any(isinstance(r[i], float) for r in rows)]
    place = exact + [i for i in order if i not in exact]
    return [columns[i] for i in order], [tuple(r[i] for i in order) for r in sorted(rows, key=lambda r: [_key(r[i]) for i in place])]


def same(a, b):
    """Equal in kind and value; floats up to the order of summation."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or math.isnan(a) and math.isnan(b)
    return type(a) is type(b) and a == b


def compare(spark, query, sql, sf=SF):
    """(got, wanted), each (columns, rows) in one order."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    cur = con.execute(sql)
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    return _rows(got.columns, [tuple(r) for r in got.collect()]), want


def check(got, want):
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if not all(map(same, a, b))]
    assert not wrong, wrong[:3]
