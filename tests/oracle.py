"""Runs an oracle's SQL in DuckDB and compares it with a Spark result."""

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    if isinstance(v, Decimal):
        return float(v)
    return "nan" if isinstance(v, float) and v != v else v


def same(df, c, sql):
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    theirs = r.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    mine = sorted((tuple(plain(x[n]) for n in order) for x in df.collect()), key=repr)
    want = sorted((tuple(plain(x[names.index(n)]) for n in order) for x in theirs), key=repr)
    assert mine == want
