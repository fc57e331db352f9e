"""A store of cells and artifact records in which both appear at once.

A commit writes its cells and its records into folders of their own, and last of all one line of the
manifest. Readers resolve through the manifest: folders that it does not name are not there for them, be
they half written or whole. So a job that fails shows nothing, and one that runs again under the same
name writes anew what nobody has seen. A name that is committed is never committed again, so a replay
adds nothing. The manifest is joined to the folders, which are pruned by it; it is not gathered anywhere.

One job at a time commits to a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..functions import periods
from ..shared import exists
from .cells import KEY
from .resolve import resolve_by_key

_CHUNK = ["dataset_id", "time_chunk"]
_COMMIT = StructField("commit", StringType())


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all commits with their ``commit``; none if nothing was ever written."""
    schema = StructType([*schema.fields, _COMMIT])
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """What is committed: ``commit`` names and their counts, in no order."""
    return _read(spark, f"{root}/manifest", schemas.MANIFEST)


def is_committed(spark: SparkSession, root: str, name: str) -> bool:
    return not manifest(spark, root).where(F.col("commit") == name).isEmpty()


def commit(spark: SparkSession, root: str, name: str, cells: DataFrame | None = None, records: DataFrame | None = None, period_type: str = "daily") -> bool:
    """Add cells (with ``ingested``, their order of ingestion) and records in one step; False if this name is committed already."""
    if is_committed(spark, root, name):
        return False
    n = {"cells": 0, "records": 0}
    if cells is not None:
        laid = cells.withColumn("time_chunk", periods.time_chunk(F.col("time"), period_type)).select(schemas.COMMITTED.names)
        by = [*_CHUNK, "lat", "lon", "time"]
        laid = laid.repartitionByRange(*by).sortWithinPartitions(*by)
        laid.write.partitionBy(*_CHUNK).mode("overwrite").parquet(f"{root}/cells/commit={name}")
    if records is not None:
        records.select(schemas.RECORDS.names).write.mode("overwrite").parquet(f"{root}/records/commit={name}")
    for kind, schema in (("cells", schemas.COMMITTED), ("records", schemas.RECORDS)):
        n[kind] = _read(spark, f"{root}/{kind}", schema).where(F.col("commit") == name).count()
    spark.createDataFrame([(n["cells"], n["records"])], schemas.MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/commit={name}")
    return True


def committed_cells(spark: SparkSession, root: str) -> DataFrame:
    """All committed rows of cells, those that newer ones took the place of included."""
    seen = manifest(spark, root).where("n_cells > 0").select("commit")
    return _read(spark, f"{root}/cells", schemas.COMMITTED).join(seen, "commit", "left_semi").drop("commit")


def committed_records(spark: SparkSession, root: str) -> DataFrame:
    seen = manifest(spark, root).where("n_records > 0").select("commit")
    return _read(spark, f"{root}/records", schemas.RECORDS).join(seen, "commit", "left_semi").drop("commit")


def newest(rows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Of each cell and time the row ingested last; of rows ingested at once the one of the largest value."""
    return resolve_by_key(rows, keys, [F.desc_nulls_last("ingested"), F.desc_nulls_last("value")])


def additions(stored: DataFrame, landed: DataFrame, period_type: str = "daily", keys: list[str] = KEY) -> DataFrame:
    """What a landing adds to committed rows: of each cell and time the row ingested last, unless the store has it.

    A stored row without an order of ingestion stays for good; another one gives way to a row that was
    ingested later. So the store ends up alike, in however many landings rows come. Of the store, only the
    chunks that the landing reaches are read.
    """
    chunk = periods.time_chunk(F.col("time"), period_type)
    reach = landed.select("dataset_id", chunk.alias("time_chunk")).distinct()
    has = stored.join(reach, _CHUNK, "left_semi").groupBy(*keys).agg(F.max(F.isnull("ingested")).alias("_final"), F.max("ingested").alias("_last"))
    new = F.col("_final").isNull() | (~F.col("_final") & F.coalesce(F.col("ingested") > F.col("_last"), F.lit(False)))
    return newest(landed, keys).join(has, keys, "left").where(new).drop("_final", "_last")
