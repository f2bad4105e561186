"""The cell store: parsing and types against pandas, and what inventories show."""

import io
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tabularium.queries import tables
from tabularium.sources import cells

RANDOM = random.Random(2)
TOKENS = {
    "whole": ["1", "-7", "+3", " 5", "00", "9223372036854775807"],
    "huge": ["9223372036854775808", "18446744073709551615", "1"],
    "beyond": ["18446744073709551616", "5"],
    "float": ["1.5", ".5", "2.", "1e5", "-1E-3", "7", "inf", "-Infinity"],
    "truth": ["True", "false", "TRUE"],
    "text": ["a", "1x", "1 2", "true ", "é", "a,b", 'say "x"', "two\nlines", "2020-01-01"],
    "none": ["", "NA", "null", "NaN", "n/a", "None"],
}


def quoted(x):
    return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') or RANDOM.random() < 0.1 else x


def table():
    width, n = RANDOM.randint(2, 6), RANDOM.randint(1, 9)
    kinds = [[k for k in TOKENS if RANDOM.random() < 0.2] or [RANDOM.choice(list(TOKENS))] for _ in range(width)]
    # numbers that 64 bits can't hold are not mixed with missing cells and fractions, where readers differ
    kinds = [[x for x in k if x in ("huge", "beyond", "text")] if {"huge", "beyond"} & set(k) else k for k in kinds]
    names = [RANDOM.choice(["a", "b", "item code", "x,y", 'q"', ""]) for _ in range(width)]
    rows = [[RANDOM.choice(TOKENS[RANDOM.choice(k)]) for k in kinds] for _ in range(n)]
    rows = [r if any(r) else ["z", *r[1:]] for r in rows]
    return RANDOM.choice(["\n", "\r\n"]).join(",".join(map(quoted, r)) for r in [names, *rows]) + RANDOM.choice(["", "\n", "\n\n"])


def test_types_and_values_as_pandas_reads_them(spark):
    files = [(k, table()) for k in range(300)]
    read = cells.csv_cells(spark.createDataFrame(files, "table_id int, content string").repartition(4)).cache()
    types, values = {}, {}
    for r in cells.typed(read).collect():
        types.setdefault(r.table_id, {})[r.column_position] = (r.column_name, r.dtype, r.n_cells, r.n_missing)
    for r in read.collect():
        values[r.table_id, r.row_position, r.column_position] = None if r.value in (*cells.MISSING, None) else r.value
    for k, text in files:
        frame, raw = pd.read_csv(io.StringIO(text)), pd.read_csv(io.StringIO(text), dtype=str)
        wanted = [(c, str(t).replace("str", "object"), len(frame), int(frame[c].isna().sum())) for c, t in frame.dtypes.items()]
        assert [types[k][j] for j in range(len(wanted))] == wanted, text
        for i, row in enumerate(raw.itertuples(index=False)):
            assert [values[k, i, j] for j in range(len(row))] == [None if pd.isna(x) else x for x in row], text


def test_odd_files(spark):
    files = [(1, None), (2, ""), (3, "\n\n"), (4, "a,b"), (5, "a,b\n1"), (6, "a\n1,2,3"), (7, 'a\n"open\n2'), (8, "a\n" + "9" * 40), (9, "a\n" + "x" * 200_000)]
    got = cells.csv_cells(spark.createDataFrame(files, "table_id int, content string"))
    rows = [(r.table_id, r.row_position, r.column_position, r.column_name) for r in got.orderBy("table_id", "row_position", "column_position").collect()]
    # a short row lacks its last cells, a long one has cells without a name
    assert rows[:2] == [(5, 0, 0, "a"), (5, 0, 1, "b")] and (6, 0, 2, None) in rows and {r[0] for r in rows} == {5, 6, 7, 8, 9}
    assert {r.table_id: r.dtype for r in cells.typed(got).where("column_position = 0").collect()}[8] == "object"
    assert cells.csv_cells(spark.createDataFrame([], "table_id int, content string")).count() == 0


def test_labels_and_chosen_rows(spark):
    files = [(1, "x,row_label_raw,item_label_norm,item_code\n" + "\n".join(f"{k},raw {k},{'' if k == 1 else f'norm  {k}'},c{k}" for k in range(12))), (2, "x,y\n1,2\n,4"), (3, "x\n" + "\n".join("abcdefghijkl"))]
    read = cells.csv_cells(spark.createDataFrame(files, "table_id int, content string"))
    rows = {(r.table_id, r.row_position): (r.label, r.code, r.title) for r in cells.row_catalog(read).collect()}
    assert rows[1, 0] == ("norm 0", "c0", None) and rows[1, 1] == (None, "c1", None) and rows[2, 0] == ("1", None, None) and rows[2, 1] == (None, None, None)
    chosen = spark.createDataFrame([(1, 3), (1, 3), (1, 99), (3, 50)], "table_id int, row_position int")
    seen = {r.table_id: r for r in cells.inventory(read, chosen).collect()}
    assert [d.row_position for d in seen[1].detailed_rows] == [3] and [v.value for v in seen[1].detailed_rows[0]["values"]] == ["3", "raw 3", "norm 3", "c3"]
    assert [d.row_position for d in seen[2].detailed_rows] == [0, 1] and seen[3].detailed_rows is None and seen[3].row_count == 12
    assert [(c.column_name, c.dtype) for c in seen[2].columns] == [("x", "float64"), ("y", "int64")]
    assert {r.table_id for r in cells.inventory(read).where("detailed_rows is not null").collect()} == {2}


def test_tables_that_spark_holds_against_sql(spark, tmp_path):
    """Texts that read as numbers or say NA, numbers beside nulls, NaN, columns of nulls, no rows."""
    odd = {"string": ["", "NA", "12", None], "int": [None, 4], "bigint": [None, 4], "double": [float("nan"), None, 2.0], "boolean": [True, None]}
    con = duckdb.connect()
    for t, names in tables.COLUMNS.items():
        kinds = dict(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").dtypes)
        n = {"region": 0, "nation": 1}.get(t, 12)
        value = lambda c: F.element_at(F.array(*(F.lit(x).cast(kinds[c]) for x in odd.get(kinds[c], [None]))), (F.col("id") % len(odd.get(kinds[c], [None])) + 1).cast("int"))  # noqa: E731, B023
        spark.range(n).select(*(value(c).alias(c) for c in names.split())).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = tables.column_types(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({tables.ORACLES['column_types']})").fetchall())


def test_files_are_described_within_their_rows(spark):
    """As by way of cells, also for odd files, and without any shuffle."""
    odd = [None, "", "\n\n", "a,b", "a,b\n1", "a\n1,2,3\n4,x", 'a\n"open\n2', "a\n" + "9" * 40, "row_label_raw,item_code,item_label_norm\nr,NA,\nq,c", "\n".join(["note_title,x", *(f"t{k},{k}" for k in range(12))]), "a,a\n 7 ,1e5\n\t8,"]
    files = spark.createDataFrame([*enumerate([*odd, *(table() for _ in range(200))])], "table_id int, content string").repartition(4, "content").localCheckpoint()
    chosen = F.when(F.col("table_id") % 2 == 0, F.array((F.col("table_id") % 5).cast("int"), F.lit(0), F.lit(0), F.lit(-1)))
    apart = files.where("table_id % 2 = 0").select("table_id", F.explode(F.array((F.col("table_id") % 5).cast("int"), F.lit(0), F.lit(-1))).alias("row_position"))
    plain = lambda df: sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["table_id"])
    for some, rows in ((None, None), (chosen, apart)):
        got = cells.described(files, some)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert plain(got) == plain(cells.inventory(cells.csv_cells(files), rows))
    assert cells.described(files.where("table_id < 0")).count() == 0


def test_cells_are_matched_once_and_not_within_aggregates(spark):
    files = spark.createDataFrame([(1, "item_label_norm,item_code\na,1\nb,2")], "table_id long, content string")
    plan = cells.inventory(cells.csv_cells(files))._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert aggregates and not any("regexp_replace" in line or "RLIKE" in line for line in aggregates)
