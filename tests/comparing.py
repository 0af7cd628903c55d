"""Rows of Spark and DuckDB results in a form that can be compared."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return plain(v.tolist()) if hasattr(v, "tolist") else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_rows(df):
    names = sorted(df.columns)
    return names, ordered(tuple(plain(r[c]) for c in names) for r in df.collect())


def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def duck_rows(con, sql):
    names = sorted(con.sql(sql).columns)
    listed = ", ".join(f'"{c}"' for c in names)
    return names, ordered(tuple(plain(x) for x in row) for row in con.sql(f"SELECT {listed} FROM ({sql})").fetchall())
