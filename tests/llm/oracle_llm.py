"""Compares a query of the subpackage with its SQL in DuckDB."""

import duckdb

from tabularium.llm.queries import ORACLES, QUERIES


def compare(spark, name, sf_dir):
    """Empty if the same; else what differs first."""
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got, wanted = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr), sorted(found.fetchall(), key=repr)
    return "" if got == wanted else f"only here {[x for x in got if x not in set(wanted)][:3]}, only there {[x for x in wanted if x not in set(got)][:3]}"
