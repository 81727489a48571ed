"""Readers and writers of customer tables, processed tables, splits and predictions."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.text import name, replacing
from ebbtide.schema import RAW_SCHEMA


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns means missing: make it NULL once, at the source."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats})


def read_customers(
    spark: SparkSession, path: str, format: str = "csv",
    schema: T.StructType | str | None = RAW_SCHEMA,
) -> DataFrame:
    """Customer table from CSV (with a header) or a self-describing format such as Parquet.

    CSV columns are matched to the schema by name, in any order; a column the schema does
    not know is text.  ``schema=None`` infers the types, which costs a pass over the file.
    A value that does not parse becomes NULL, so a bad row fails alone at scoring.
    """
    if format != "csv":
        return nan_to_null(spark.read.format(format).load(path))
    if schema is None:
        return nan_to_null(spark.read.csv(path, header=True, inferSchema=True))
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    known = {f.name: f.dataType for f in schema.fields}
    header = spark.read.csv(path, header=True).columns  # reads the first line
    whole = {n for n in header if isinstance(known.get(n), T.IntegralType)}
    read_as = T.StructType([
        T.StructField(n, T.StringType() if n in whole else known.get(n, T.StringType())) for n in header])
    frame = spark.read.schema(read_as).csv(path, header=True)
    return nan_to_null(frame.selectExpr(*replacing(header, {n: whole_number(n, known[n]) for n in whole})))


def whole_number(column: str, kind: T.DataType) -> str:
    """Whole numbers are often written as 35.0 where the column has gaps."""
    c = name(column)
    decimal = f"try_cast({c} AS DOUBLE)"
    rounded = f"CASE WHEN {decimal} = floor({decimal}) THEN try_cast({decimal} AS BIGINT) END"
    return f"try_cast(coalesce(try_cast({c} AS BIGINT), {rounded}) AS {kind.simpleString()})"


def write_processed(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Processed features with their label."""
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def read_processed(
    spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.options(header=True, inferSchema=schema is None)
    return reader.load(path)


def write_split(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Train and test rows as one table, partitioned by the split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, part: str, split_col: str = "split") -> DataFrame:
    """One side of the split; only its partition directory is listed and read."""
    return spark.read.parquet(path).filter(F.col(split_col) == part).drop(split_col)


def export_predictions(df: DataFrame, base_dir: str, path: str | None = None) -> str:
    """Write predictions as CSV with a header; the default path is new for every call.

    Spark publishes the files of a folder together, and a given ``path`` must not exist.
    """
    target = path or f"{base_dir}/predictions_{datetime.now():%Y%m%d_%H%M%S_%f}_{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").option("header", True).csv(target)
    return target
