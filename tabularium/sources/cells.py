"""A cell store: tables of any shapes as one relation with a row for each cell.

(table_id, row_position, column_position, column_name, value): values are
strings, null where a cell is missing. Types are found from the cells of a column by one aggregate; a
table's rows and columns are described for a planner without reading its file again.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.text import collapse, let
from tabularium.operators.selection import CELL

# What a table file may say for a missing cell, and for truth values.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")
# Dtypes of Spark's types; all others are objects.
DECLARED = {"int": "int64", "bigint": "int64", "float": "float64", "double": "float64", "boolean": "bool"}
# Names of the columns that identify a row.
LABELS, CODE, TITLE = ("item_label_norm", "row_label_raw"), "item_code", "note_title"

#: Tables of at most so many rows are shown whole if no rows were chosen.
SHOWN = 8
_INT, _FLOAT = r"^[ \t]*[+-]?[0-9]+[ \t]*$", r"^[ \t]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))[ \t]*$"
#: Stands for a line break within quotes while a file is cut into lines.
_BREAK = "\x1e"


def declared(df: DataFrame, table_id: str) -> DataFrame:
    """(table_id, column_position, column_name, dtype, n_cells, n_missing) of a table that Spark holds, from one aggregate over all its rows.

    What typed() finds for files is known here: a text stays object though it reads as a number or says NA, numbers and truth values
    keep their type beside nulls, only nulls are missing (NaN is a number), and a table without rows has columns, too.
    """
    counted = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(c)).alias(f"c{k}") for k, c in enumerate(df.columns)))
    column = lambda k, c, kind: F.struct(F.lit(k).alias("column_position"), F.lit(c).alias("column_name"), F.lit(DECLARED.get(kind, "object")).alias("dtype"), F.col("n").alias("n_cells"), (F.col("n") - F.col(f"c{k}")).alias("n_missing"))
    return counted.select(F.lit(table_id).alias("table_id"), F.inline(F.array(*(column(k, *known) for k, known in enumerate(df.dtypes)))))


def _records(content: Column) -> Column:
    """The lines of a file that are not blank; line breaks within quotes do not end one."""
    parts = F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), '"', -1)
    # every other piece stands within quotes; a doubled quote gives an empty piece outside of them
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.translate(x, "\n", _BREAK)).otherwise(x)), '"')
    return F.filter(F.split(joined, "\n", -1), lambda x: x != "")


def _names(header: Column) -> Column:
    """Column names: none twice, and none empty."""
    named = F.transform(header, lambda x, i: F.when(F.coalesce(x, F.lit("")) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(x))
    again = lambda x, i: F.size(F.filter(F.slice(named, F.lit(1), i), lambda y: y == x))
    return F.transform(named, lambda x, i: F.when(again(x, i) > 0, F.concat(x, F.lit("."), again(x, i).cast("string"))).otherwise(x))


def _commas(x: Column) -> Column:
    return F.char_length(x) - F.char_length(F.replace(x, F.lit(","), F.lit("")))


def _most(lines: DataFrame) -> int:
    """Of all lines (arrays) the most separators, within quotes or not."""
    return lines.agg(F.max(F.array_max(F.transform("lines", _commas)))).first()[0] or 0


def _read(line: Column, most: int) -> Column:
    """A line as struct<c0, c1, ...> of most + 1 fields."""
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxColumns": str(most + 2), "maxCharsPerColumn": "-1", "emptyValue": ""}
    return F.from_csv(line, ", ".join(f"c{k} string" for k in range(most + 1)), options)


def _fields(read: Column, line: Column, most: int) -> Column:
    """The fields that a line has, of what was read of it: as many as separators outside of quotes, and one."""
    outside = F.array_join(F.transform(F.split(line, '"', -1), lambda p, i: F.when(i % 2 == 0, p).otherwise(F.lit(""))), "")
    return F.slice(F.array(*(F.translate(read[f"c{k}"], _BREAK, "\n") for k in range(most + 1))), F.lit(1), _commas(outside) + 1)


def csv_cells(files: DataFrame, table_id: str = "table_id", content: str = "content") -> DataFrame:
    """The cells of files with a header, each with columns of its own; fields beyond the header have no name."""
    lines = files.select(F.col(table_id).alias("table_id"), _records(F.col(content)).alias("lines")).where(F.size("lines") > 0)
    most = _most(lines)

    def with_fields(rows: DataFrame, line: str, name: str) -> DataFrame:
        return rows.withColumn("_read", _read(F.col(line), most)).withColumn(name, _fields(F.col("_read"), F.col(line), most)).drop("_read", line)

    heads = with_fields(lines.select("table_id", F.element_at("lines", 1).alias("head"), F.slice("lines", 2, 1 << 30).alias("rest")), "head", "head_fields")
    # names are made once a file; in one select with the rows they would be made for each
    named = heads.select("table_id", _names(F.col("head_fields")).alias("names"), "rest")
    rows = named.select("table_id", "names", F.posexplode("rest").alias("row_position", "line"))
    parsed = with_fields(rows, "line", "values")
    cells = parsed.select("table_id", "row_position", F.posexplode(F.arrays_zip("names", "values")).alias("column_position", "c"))
    return cells.select("table_id", "row_position", "column_position", F.col("c.names").alias("column_name"), F.col("c.values").alias("value"))


def is_missing(value: Column) -> Column:
    return value.isNull() | value.isin(*MISSING)


def typed(cells: DataFrame, by: Sequence[str] = ("table_id", "column_position", "column_name")) -> DataFrame:
    """For each column its dtype (int64, uint64, float64, bool, object), how many cells it has and how many are missing.

    A column is of the narrowest type that all its cells can be read as; whole numbers with a missing cell are float64,
    truth values with one are object, and a column without any value is float64.
    """
    # each cell is matched once, for all that is counted of it
    v = F.col("value")
    seen = cells.select(*by, "value", is_missing(v).alias("none"), v.rlike(_INT).alias("whole"))
    number = F.when(F.col("whole"), F.expr("try_cast(trim(BOTH ' \t' FROM value) AS decimal(38, 0))"))
    marked = seen.select(*by, "none", "whole", number.alias("number"), v.isin(*TRUTH).alias("truth"), (F.col("whole") | v.rlike(_FLOAT)).alias("decimal"))
    none, number = F.col("none"), F.col("number")
    every = lambda c: F.bool_and(none | c)
    held = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(none).alias("n_missing"),
        every(F.col("truth")).alias("truth"),
        every(F.col("whole")).alias("whole"),
        every(F.coalesce(number.between(-(1 << 63), (1 << 63) - 1), F.lit(False))).alias("signed"),
        every(F.coalesce(number.between(0, Decimal((1 << 64) - 1)), F.lit(False))).alias("unsigned"),
        every(F.col("decimal")).alias("decimal"),
    )
    dtype = _dtype(F.col("n_missing") == F.col("n_cells"), F.col("n_missing") == 0, *map(F.col, ("truth", "whole", "signed", "unsigned", "decimal")))
    return held.select(*by, dtype.alias("dtype"), "n_cells", "n_missing")


def _dtype(none: Column, full: Column, truth: Column, whole: Column, signed: Column, unsigned: Column, decimal: Column) -> Column:
    """The type of a column by what holds for all its cells; none, full: all or no cells are missing."""
    return (
        F.when(none, "float64")
        .when(truth, F.when(full, "bool").otherwise("object"))
        .when(whole & full, F.when(signed, "int64").when(unsigned, "uint64").otherwise("object"))
        .when(decimal, "float64")
        .otherwise("object")
    )


#: What _marks() says of a cell, as bits.
_NONE, _FULL, _TRUTH, _WHOLE, _SIGNED, _UNSIGNED, _DECIMAL = (1 << k for k in range(7))
_ALL = (1 << 7) - 1


def _marks(value: Column) -> Column:
    """What typed() counts of a cell, as bits that are set for a column if they are for all its cells."""
    bit = lambda k, c: F.when(F.coalesce(c, F.lit(False)), k).otherwise(0)
    number = F.trim(value, F.lit(" \t")).try_cast("decimal(38, 0)")
    whole = let(number, lambda n: F.lit(_FULL | _WHOLE | _DECIMAL) + bit(_SIGNED, n.between(-(1 << 63), (1 << 63) - 1)) + bit(_UNSIGNED, n.between(0, Decimal((1 << 64) - 1))))
    return F.when(is_missing(value), _ALL - _FULL).when(value.rlike(_INT), whole).otherwise(F.lit(_FULL) + bit(_TRUTH, value.isin(*TRUTH)) + bit(_DECIMAL, value.rlike(_FLOAT)))


def _compact(value: Column) -> Column:
    return F.nullif(F.substring(collapse(value), 1, CELL), F.lit(""))


def _shown(cells: DataFrame) -> DataFrame:
    """cells with what is shown of their values, made once for each."""
    return cells.withColumn("shown", F.when(~is_missing(F.col("value")), _compact(F.col("value"))))


def _identity() -> list[Column]:
    """Aggregates over _shown() cells of a row: its label (of a label column, else of the first column), code and title."""
    known = F.array(*map(F.lit, LABELS))
    # label columns come first, in their order, and then the columns as they stand
    place = F.when(F.col("column_name").isin(*LABELS), F.array_position(known, F.col("column_name")) - len(LABELS) - 1).otherwise(F.col("column_position"))
    value = F.col("shown")
    of = lambda name: F.max(F.when(F.col("column_name") == name, value))
    return [F.min_by(value, place).alias("label"), of(CODE).alias("code"), of(TITLE).alias("title")]


def row_catalog(cells: DataFrame) -> DataFrame:
    """A row for each row of a table, with its label, code and title."""
    return _shown(cells).groupBy("table_id", "row_position").agg(*_identity())


def inventory(cells: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """What a planner sees of each table: row_count, columns with dtypes, all rows by label, code and title, and chosen rows in full.

    chosen (table_id, row_position): rows that are shown in full; tables of SHOWN rows at most without such rows are shown whole.
    Catalogues are gathered per table, since a planner reads a table's as a whole; for tables too long for that
    use row_catalog() and typed(), whose rows are not gathered.
    """
    columns = typed(cells).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("column_position", "column_name", "dtype"))).alias("columns"))
    value = F.col("shown").alias("value")
    whole = _shown(cells).groupBy("table_id", "row_position").agg(*_identity(), F.array_sort(F.collect_list(F.struct("column_position", "column_name", value))).alias("values"))
    rows = whole.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_position", "label", "code", "title", "values"))).alias("rows"))
    if chosen is None:
        rows = rows.withColumn("chosen", F.array().cast("array<int>"))
    else:
        own = chosen.groupBy("table_id").agg(F.collect_set(F.col("row_position").cast("int")).alias("chosen"))
        rows = rows.join(own, "table_id", "left").withColumn("chosen", F.coalesce("chosen", F.array().cast("array<int>")))
    own = F.filter("rows", lambda r: F.array_contains("chosen", r["row_position"]))
    shown = F.when(F.size(own) > 0, own).when(F.size("rows") <= SHOWN, F.col("rows"))
    named = lambda c, *names: F.transform(c, lambda r: F.struct(*(r[x].alias(x) for x in names)))
    return rows.select("table_id", F.size("rows").cast("long").alias("row_count"), named("rows", "row_position", "label", "code", "title").alias("row_catalog"), named(shown, "row_position", "values").alias("detailed_rows")).join(columns, "table_id")


def described(files: DataFrame, chosen: Column | None = None, table_id: str = "table_id", content: str = "content") -> DataFrame:
    """inventory(csv_cells(files)) without a row for each cell: a file is parsed, typed and described within its own row, and nothing is shuffled.

    chosen: of a file, an array of the positions of rows that are shown in full. files are read twice, so they should be kept.
    """
    none = F.array().cast("array<int>")
    own = F.coalesce((none if chosen is None else chosen).cast("array<int>"), none)
    lines = files.select(F.col(table_id).alias("table_id"), own.alias("chosen"), _records(F.col(content)).alias("lines")).where(F.size("lines") > 1)
    most = _most(lines)
    fields = lambda x: let(_read(x, most), lambda r: _fields(r, x, most))
    heads = lines.select("table_id", "chosen", fields(F.element_at("lines", 1)).alias("head"), F.slice("lines", 2, 1 << 30).alias("rest"))
    named = heads.select("table_id", "chosen", _names(F.col("head")).alias("names"), "rest")
    # a short line lacks its last cells, a long one has cells without a name
    parsed = named.select("table_id", "chosen", "names", F.transform("rest", lambda x: F.zip_with(fields(x), "names", lambda value, name: value)).alias("values"))
    shown = F.transform("values", lambda v: F.transform(v, lambda x: F.when(~is_missing(x), _compact(x))))
    both = lambda a, b: F.coalesce(a, F.lit(_ALL)).bitwiseAND(F.coalesce(b, F.lit(_ALL)))
    marks = F.aggregate("values", none, lambda held, v: F.zip_with(held, F.transform(v, _marks), both))
    seen = parsed.select("table_id", "chosen", "names", shown.alias("shown"), marks.alias("marks"))
    at = lambda name: F.nullif(F.array_position("names", name), F.lit(0)).cast("int")
    places = seen.select("*", F.coalesce(*map(at, LABELS), F.lit(1)).alias("label"), at(CODE).alias("code"), at(TITLE).alias("title"))
    has = lambda k: lambda m: m.bitwiseAND(F.lit(k)) != 0
    dtype = lambda m: _dtype(*(has(k)(m) for k in (_NONE, _FULL, _TRUTH, _WHOLE, _SIGNED, _UNSIGNED, _DECIMAL)))
    name = lambda i: F.get(F.col("names"), i).alias("column_name")
    columns = F.transform("marks", lambda m, i: F.struct(i.alias("column_position"), name(i), dtype(m).alias("dtype")))
    catalogue = F.transform("shown", lambda v, i: F.struct(i.alias("row_position"), *(F.get(v, F.col(c) - 1).alias(c) for c in ("label", "code", "title"))))
    rows = F.transform("shown", lambda v, i: F.struct(i.alias("row_position"), F.transform(v, lambda x, j: F.struct(j.alias("column_position"), name(j), x.alias("value"))).alias("values")))
    wanted = F.filter(rows, lambda r: F.array_contains("chosen", r["row_position"]))
    found = F.exists("chosen", lambda p: (p >= 0) & (p < F.size("shown")))
    full = F.when(found, wanted).when(F.size("shown") <= SHOWN, rows)
    return places.select("table_id", F.size("shown").cast("long").alias("row_count"), catalogue.alias("row_catalog"), full.alias("detailed_rows"), columns.alias("columns"))
