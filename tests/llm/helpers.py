"""Shared by the tests of the training-data operators."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = ["documents", "pages", "labels", "conversations"]


def documents(spark, rows, extra=""):
    """rows: (doc_id, text[, lang[, source]]); n_chars is filled in."""
    full = []
    for r in rows:
        r = (*r, *(None,) * (4 - len(r)))
        full.append((*r, None if r[1] is None else len(r[1])))
    return spark.createDataFrame(full, DOCS)


def duck(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def same_as_sql(df, sql, con=None):
    rel = (con or duck()).sql(sql)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]

    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want
