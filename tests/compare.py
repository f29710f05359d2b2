"""Holds a query's rows against those of its SQL in DuckDB."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def differences(spark, sf_dir, f, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    got = con.execute(sql)
    theirs_names = [c[0] for c in got.description]
    assert sorted(theirs_names) == names
    theirs = sorted((tuple(plain(r[theirs_names.index(c)]) for c in names) for r in got.fetchall()), key=repr)
    return [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b] or (len(ours) != len(theirs) and [len(ours), len(theirs)])
