"""Creating managed datasets: a batch of requests from validation to cells and records in a store, in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import identity, periods
from ..operators import catalog, ranks, store
from ..operators.resolve import resolve_by_key
from ..shared import cut
from .sync import in_box

#: What makes two requests of one dataset the same, as records have it.
SCOPE = ["request_start", "request_end", "extent_id", "bbox"]


def resolved(requests: DataFrame, templates: DataFrame, extents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their scope, box and managed id, and those that name an unknown dataset or extent.

    ``requests``: request_id, dataset_id, start, end, extent_id, bbox and overwrite. A request's own box goes before its extent's.
    """
    found, lost = catalog.matched_requests(requests, templates, extents)
    side = lambda i, s: F.get("extent_bbox", F.lit(i)).alias(s)
    area = F.coalesce("bbox", F.when(F.col("extent_bbox").isNotNull(), F.struct(*(side(i, s) for i, s in enumerate(identity.SIDES)))))
    found = found.withColumns({"bbox": area, "managed_id": identity.managed_id(F.col("dataset_id"), F.col("extent_id"), F.col("bbox"))})
    found = found.withColumnsRenamed({"start": "request_start", "end": "request_end"})
    return found.join(templates.select("dataset_id", "period_type"), "dataset_id"), lost.select("request_id", "reason")


def accepted(found: DataFrame, records: DataFrame) -> DataFrame:
    """Of each dataset and scope the first request, unless a record has it already and the request does not overwrite."""
    first = resolve_by_key(found, ["dataset_id", *SCOPE], [F.desc("overwrite"), F.asc("request_id")])
    new = catalog.new_requests(records, first.where("not overwrite"), SCOPE)
    return first.where("overwrite").unionByName(new)


def spans(wanted: DataFrame, as_of: str) -> DataFrame:
    """The windows of each managed dataset, those that overlap or touch as one: dataset_id, managed_id, ``_box``, ``_lo``, ``_hi``."""
    lo, hi = periods.lower_bound(F.col("request_start")), periods.upper_bound(F.coalesce("request_end", F.lit(as_of)))
    w = Window.partitionBy("dataset_id", "managed_id").orderBy("_lo", "_hi")
    one = wanted.select("dataset_id", "managed_id", F.col("bbox").alias("_box"), lo.alias("_lo"), hi.alias("_hi")).where("_lo < _hi").distinct()
    one = one.withColumn("_before", F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    one = one.withColumn("_island", F.sum(F.when(F.col("_lo") <= F.col("_before"), 0).otherwise(1)).over(w))
    # One managed dataset has one box: its extent's, or the one that its id is made of.
    return one.groupBy("dataset_id", "managed_id", "_island").agg(F.first("_box").alias("_box"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_island")


def create(spark: SparkSession, root: str, requests: DataFrame, templates: DataFrame, extents: DataFrame, landed: DataFrame, as_of: str, name: str) -> DataFrame:
    """Carry out a batch of requests; returns ``request_id`` and ``reason`` of those that made no record.

    ``landed``: cells of template datasets, as schemas.LANDED. Cells that the store lacks, or has from an
    earlier ingestion, and a record for each request, with what the managed dataset now covers, appear at
    once. A request that the store has had already (``known``), or of whose managed dataset there is no cell
    (``no data``), makes no record; of equal requests of a batch, one does (the others are ``known``). If ``name`` is
    committed already, nothing is done, and the reasons are those of the first time for what is rejected.
    """
    records = store.committed_records(spark, root)
    found, lost = resolved(requests, templates, extents)
    found = cut(found)
    wanted = cut(accepted(found, records))
    due = spans(wanted, as_of)
    met = landed.drop("managed_id").join(due, "dataset_id").where("time >= _lo and time < _hi").where(in_box())
    new = cut(store.additions(store.committed_cells(spark, root), met.withColumn("dataset_id", F.col("managed_id")).select(schemas.LANDED.names)))
    touched = wanted.select(F.col("managed_id").alias("dataset_id")).distinct()
    have = store.committed_cells(spark, root).select("dataset_id", "time").unionByName(new.select("dataset_id", "time"))
    covers = have.join(touched, "dataset_id", "left_semi").groupBy(F.col("dataset_id").alias("managed_id")).agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    last = records.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    kept = ranks.placed(wanted.join(covers, "managed_id"), [], [F.asc("request_id")], "place")
    text = lambda t: periods.period_string(F.col(t), F.col("period_type"))
    made = cut(kept.select(
        (F.col("place") + last).alias("seq"), F.concat_ws("-", F.lit(name), F.col("request_id").cast("string")).alias("artifact_id"), "managed_id", "dataset_id", "extent_id", "bbox", F.lit("zarr").alias("format"),
        F.lit(as_of).cast("timestamp").alias("created_at"), "request_start", "request_end", text("t0").alias("coverage_start"), text("t1").alias("coverage_end"), "request_id",
    ))
    store.commit(spark, root, name, new, made)
    none = wanted.join(made, "request_id", "left_anti").select("request_id", F.lit("no data").alias("reason"))
    known = found.join(wanted, "request_id", "left_anti").select("request_id", F.lit("known").alias("reason"))
    return lost.unionByName(none).unionByName(known)
