"""Levels of text columns as a table, for columns with any number of levels.

The levels of a fit are sorted over all partitions and numbered there; no level reaches the driver.
Encoding joins rows with the table and makes sparse vectors, one element per column, which the
linear learners and ``wide_pca`` take as they are.  An unseen level gives zeros.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.features import repaired
from ebbtide.operators.assemble import FEATURES
from ebbtide.sources.staging import new_path, stage


class Levels(NamedTuple):
    """``column, level, position`` (0-based, in the order of the levels), and levels per column."""

    table: DataFrame
    sizes: dict[str, int]
    repair: bool


def _level(column: str, repair: bool) -> Column:
    value = F.col(f"`{column}`").cast("string")
    return repaired(value) if repair else value


def fit_level_table(df: DataFrame, columns: list[str], repair: bool = True) -> Levels:
    """Number the levels of all columns: one shuffle of distinct levels, sorted by range.

    A missing value is the level that ``repair`` gives it, or none.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _level(c, repair).alias("level")) for c in columns
    ])).alias("s")).select("s.*").where("level IS NOT NULL").distinct()
    ordered = stacked.repartitionByRange("column", "level").sortWithinPartitions("column", "level")

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                places.append(seen.get(c, 0))
                seen[c] = places[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())],
                names=["column", "level", "part", "place"])

    numbered = stage(ordered.mapInArrow(number, "column string, level string, part int, place long"), "levels")
    # A row per column and partition: where the partition's levels begin.
    counts = numbered.groupBy("column", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("column", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    table = stage(numbered.join(starts, ["column", "part"]).select(
        "column", "level", (F.col("start") + F.col("place")).alias("position")), "level_table")
    sizes = {r["column"]: r.n for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    return Levels(table, {c: sizes.get(c, 0) for c in columns}, repair)


def level_positions(df: DataFrame, levels: Levels) -> DataFrame:
    """Add ``<column>_position``; NULL for an unseen level."""
    for c in levels.sizes:
        own = levels.table.where(F.col("column") == c).select(
            F.col("level").alias("__level"), F.col("position").alias(f"{c}_position"))
        df = df.withColumn("__value", _level(c, levels.repair)).join(
            own, F.col("__value") == F.col("__level"), "left").drop("__value", "__level")
    return df


def sparse_parts(df: DataFrame, numeric: list[str], levels: Levels, keep: list[str]) -> DataFrame:
    """``keep`` columns and the parts of a sparse vector: numeric columns first, then all levels.

    Columns ``type, size, indices, values`` of a struct, as MLlib stores a vector.  A missing
    number is NaN.
    """
    placed = level_positions(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *numeric, *levels.sizes])]), levels)
    places, start = [F.lit(i) for i in range(len(numeric))], len(numeric)
    for c, n in levels.sizes.items():
        places.append((F.col(f"{c}_position") + start).cast("int"))
        start += n
    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in numeric]
    hot = [F.when(F.col(f"{c}_position").isNotNull(), 1.0) for c in levels.sizes]
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(start).alias("size"),
                      F.array_compact(F.array(*places)).alias("indices"), F.array_compact(F.array(*values, *hot)).alias("values"))
    return placed.select(*[F.col(f"`{c}`") for c in keep], vector.alias(FEATURES))


def assemble_wide(df: DataFrame, numeric: list[str], levels: Levels, keep: list[str]) -> DataFrame:
    """``keep`` columns and one sparse vector ``features``, written once.

    The parts are written as a struct and read again as vectors, which have the same layout on
    disk; so no row passes through Python and the vector carries no list of a million names.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "wide")
    parts = sparse_parts(df, numeric, levels, keep)
    parts.write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT() if f.name == FEATURES else f.dataType) for f in parts.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)
