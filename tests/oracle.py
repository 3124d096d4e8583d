"""Rows of a query and of its SQL, made comparable."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order] for r in rows), key=repr)


def same(df, con, sql):
    rel = con.sql(sql)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(rel.columns, rel.fetchall())
