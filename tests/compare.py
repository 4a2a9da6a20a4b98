"""Spark result against DuckDB's for the same tables."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def both(spark, query, sql: str, sf_dir: str) -> tuple[tuple, tuple]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = database(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    want = rows_of(names, found.fetchall())
    return (sorted(df.columns), got), (sorted(names), want)


def exists(sf_dir: str) -> bool:
    return bool(glob.glob(f"{sf_dir}/*.parquet"))
