"""Rows of Spark and DuckDB as sorted tuples of text, columns by name."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "~" if value != value else f"{value:.9g}"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return str(sorted((k, text(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(text, value)) + "]"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in data)


def spark_rows(frame):
    return rows(frame.columns, [tuple(r) for r in frame.collect()])


def duck_rows(sql, where):
    con = duckdb.connect()
    for table in TABLES:
        if os.path.exists(path := f"{where}/{table}.parquet"):
            con.execute(f"create view {table} as select * from read_parquet('{path}')")
    found = con.execute(sql)
    return rows([c[0] for c in found.description], found.fetchall())
