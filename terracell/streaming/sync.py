"""Arrival-driven sync: landed files are committed to a store as they come, each cell by its newest row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import store
from ..shared import cut, exists


def _stream_id(spark: SparkSession, state: str) -> str:
    """A name of the stream that lives as long as its state does, so that a new state makes new names of batches."""
    path = f"{state}-id"
    if not exists(spark, path) or not exists(spark, state):
        spark.createDataFrame([(uuid.uuid4().hex,)], "id string").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("id string").parquet(path).first()["id"]


def stream_sync(spark: SparkSession, landing: str, root: str, state: str, period_type: str = "daily", files_per_batch: int | None = None) -> StreamingQuery:
    """Commit what has landed since the last run, a batch at a time, and end.

    Landed rows are schemas.LANDED; where ``ingested`` is null, the time at which the file was written
    orders them. A batch adds what ``store.additions`` says and is recorded in the store's manifest by
    the number that Spark gives it, so that a replayed batch adds nothing, and one that fails half way
    shows nothing. ``store.newest`` of the store is the same in however many batches files come, and is
    what ``sync.incremental`` adds at once.
    """
    stream = _stream_id(spark, state)

    def append(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        name = f"{stream}-{number}"
        if store.is_committed(s, root, name):  # a replay
            return
        # Kept, as the ranges of a commit read what they are given twice.
        new = cut(store.additions(store.committed_cells(s, root), batch, period_type))
        store.commit(s, root, name, new, period_type=period_type)

    reader = spark.readStream.schema(schemas.LANDED)
    landed = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(landing)
    order = F.coalesce("ingested", F.unix_micros("_metadata.file_modification_time"))
    landed = landed.withColumn("ingested", order).select(schemas.LANDED.names)
    return landed.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()
