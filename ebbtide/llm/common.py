"""Shared pieces of the text operators: narrow readers, Arrow maps and worker-local state."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that a task function holds as Python objects at a time.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_type(docs: DataFrame) -> str:
    """SQL type of ``doc_id``; operators hand the column on as it is."""
    return docs.schema["doc_id"].dataType.simpleString()


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns in that order; whatever else the table has is not read."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def worker_store(key: str, make: Callable[[], object]) -> object:
    """An object built once per Python worker and kept for its later tasks."""
    holder = sys.modules.setdefault("ebbtide_worker_store", types.ModuleType("ebbtide_worker_store"))
    store = holder.__dict__.setdefault("store", {})
    if key not in store:
        store[key] = make()
    return store[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_rows(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Apply ``work`` to bounded slices of Arrow batches; it returns the output columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for part in slices(batches):
            columns = work(part)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, target.types)],
                schema=target)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def text_code(text: bytes) -> bytes:
    """128 bits that stand for a text, to tell rows with one id (or none) apart."""
    return hashlib.sha256(text).digest()[:16]


def text_code_column(text: Column) -> Column:
    """``text_code`` of a column, null as the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding, null as the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
