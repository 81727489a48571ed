"""Delimited customer files read with a record of what did not parse.

All cells are read as text and parsed afterwards, so a bad cell costs its own value only.  What
went wrong is kept beside the row in ``problems``: the column, the text as it was and the cause.
A row with too few or too many cells has a problem without a column and its line as the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.text import name
from ebbtide.schema import RAW_SCHEMA
from ebbtide.sources.tables import nan_to_null, whole_number

PROBLEMS, _LINE = "problems", "__line"
_PROBLEM = "struct<column:string,text:string,cause:string>"


def _problem(column: str | None, text: Column, cause: Column) -> Column:
    return F.struct(F.lit(column).cast("string").alias("column"), text.alias("text"), cause.alias("cause"))


def _parsed(field: T.StructField) -> tuple[str, Column]:
    """Value of a cell of text as SQL, and its problem or NULL.

    An empty cell is missing, and so is ``NaN`` in a number; neither is a problem.
    """
    column, kind = name(field.name), field.dataType
    text = F.col(column)
    filled = F.trim(text) != ""
    if isinstance(kind, T.StringType):
        return column, F.lit(None).cast(_PROBLEM)
    if isinstance(kind, T.IntegralType):
        value = whole_number(field.name, kind)
        number = F.expr(f"try_cast({column} AS DOUBLE)")
        cause = (F.when(number.isNull(), "not a number").when(number != F.floor(number), "not a whole number")
                 .otherwise("out of range"))
        bad = F.expr(value).isNull() & ~F.coalesce(F.isnan(number), F.lit(False))
    else:
        value = f"try_cast({column} AS {kind.simpleString()})"
        cause = F.lit("not a number" if isinstance(kind, T.NumericType) else f"not a {kind.simpleString()}")
        bad = F.expr(value).isNull()
    return value, F.when(filled & bad, _problem(field.name, text, cause))


def _row_problem(cells: int, separator: str) -> Column:
    """The problem of a line whose number of cells is not that of the table."""
    line = F.col(_LINE)
    bare = F.regexp_replace(line, '"([^"]|"")*"', "")  # separators inside quotes are no separators
    found = F.size(F.split(bare, re.escape(separator), -1))
    cause = (F.when(found == cells, F.lit("bad quotes"))
             .otherwise(F.concat(F.when(found > cells, "too many cells: ").otherwise("too few cells: "), found.cast("string"), F.lit(f" of {cells}"))))
    return F.when(line.isNotNull(), _problem(None, line, cause))


def read_checked(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, header: bool = True, separator: str = ",") -> DataFrame:
    """Typed columns and ``problems``, an array that is empty for a sound row.

    Without a header the columns are those of the schema in their order; with one they are matched
    by name and unknown ones are text.
    """
    known = {f.name: f.dataType for f in schema.fields}
    # A quote inside quotes is doubled, as spreadsheets and data frames write it.
    options = {"header": header, "sep": separator, "escape": '"', "columnPruning": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE}
    names = spark.read.options(header=True, sep=separator, escape='"').csv(path).columns if header else schema.names
    fields = [T.StructField(n, known.get(n, T.StringType())) for n in names]
    read_as = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _LINE]])
    raw = spark.read.schema(read_as).options(**options).csv(path)
    parsed = [_parsed(f) for f in fields]
    checks = F.array_compact(F.array(_row_problem(len(names), separator), *[p for _, p in parsed]))
    typed = raw.select(*[F.expr(v).alias(f.name) for f, (v, _) in zip(fields, parsed)], checks.alias(PROBLEMS))
    return nan_to_null(typed)


def problem_texts(problems: str | Column = PROBLEMS) -> Column:
    """One text per problem: ``column: cause (text)``, the cause alone for a whole row."""
    return F.transform(problems, lambda p: F.when(p["column"].isNull(), p["cause"]).otherwise(
        F.concat(p["column"], F.lit(": "), p["cause"], F.lit(" ("), p["text"], F.lit(")"))))


def problem_report(df: DataFrame, problems: str = PROBLEMS) -> DataFrame:
    """``column, cause, rows`` of a checked table: what to mend first."""
    return (df.select(F.explode(problems).alias("p")).groupBy(F.col("p.column").alias("column"), F.regexp_replace("p.cause", ":.*", "").alias("cause"))
            .agg(F.count("*").alias("rows")))
