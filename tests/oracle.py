"""Spark results against DuckDB's on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    return str(v)


def compare(spark, name, query, sql, sf_dir):
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = con.execute(sql)
    theirs_names = [c[0] for c in rel.description]
    order = [theirs_names.index(c) for c in names]
    theirs = sorted(tuple(plain(r[k]) for k in order) for r in rel.fetchall())
    assert len(mine) == len(theirs), (name, len(mine), len(theirs))
    assert mine == theirs, (name, [x for x in zip(mine, theirs) if x[0] != x[1]][:3])
    return len(mine)
