"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def same(df, sql):
    con = connect()
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want, got = canonical(columns, found.fetchall()), canonical(df.columns, df.collect())
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, (len(wrong), wrong[:3])
