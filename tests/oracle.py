"""Compares a query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, query, sql, sf_dir):
    """Empty if the same; else what differs first."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    wanted = rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == wanted:
        return ""
    a, b = [x for x in got if x not in set(wanted)], [x for x in wanted if x not in set(got)]
    return f"{len(got)} and {len(wanted)} rows; only here {a[:3]}, only there {b[:3]}"
