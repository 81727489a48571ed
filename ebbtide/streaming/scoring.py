"""Scoring of arriving customers as a stateless stream.

Each micro-batch runs the same functions as the batch path: validate, align, scale, score,
band.  Accepted and rejected rows go to two tables.  A batch writes both to folders of its own
attempt and then commits them together under its number; a batch that is replayed after a failure
finds its commit and does nothing, or writes new folders.  ``read_results`` reads committed
batches only, so every row is seen once and nobody lists a folder while it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ebbtide.operators.score import score_batch
from ebbtide.operators.validate import accepted, rejected, validate_requests
from ebbtide.sources.models import ModelSet
from ebbtide.sources.publish import commit, latest, new_folder, read_committed


def score_requests(df: DataFrame, models: ModelSet, texts: str = "api") -> tuple[DataFrame, DataFrame]:
    """Scored rows and rejected rows of a frame of requests."""
    validated = validate_requests(df)
    scored = score_batch(accepted(validated), models, texts=texts, variant="api")
    return scored, rejected(validated)


def score_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    models: ModelSet,
    target: str,
    checkpoint: str,
    format: str = "parquet",
    files_per_batch: int = 64,
    options: dict[str, str] | None = None,
) -> StreamingQuery:
    """Start scoring the files of a folder; processes what is there, then stops.

    Results: ``read_results(spark, target, "scored")`` and ``"rejected"``.
    """
    arriving = (
        spark.readStream.schema(schema).format(format)
        .options(maxFilesPerTrigger=files_per_batch, **(options or {})).load(source)
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if latest(spark, target, batch_id):
            return
        # Two sinks read the batch: keep it so that the files are parsed once.
        batch = batch.persist()
        try:
            scored, refused = score_requests(batch, models)
            folders = {part: new_folder(target, f"{part}/batch={batch_id}").replace("attempt-", "attempt=") for part in ("scored", "rejected")}
            scored.withColumn("scored_at", F.current_timestamp()).write.parquet(folders["scored"])
            refused.write.parquet(folders["rejected"])
            commit(spark, target, folders, batch_id)
        finally:
            batch.unpersist()

    return (
        arriving.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_results(spark: SparkSession, target: str, part: str) -> DataFrame | None:
    """Rows of all committed batches, ``part`` is "scored" or "rejected"; None before the first."""
    return read_committed(spark, target, part)
