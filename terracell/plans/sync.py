"""Rolling datasets forward: what is due, for the whole catalog at once, and adding it once only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import periods
from ..operators import catalog, cells, store
from ..schemas import BBOX
from ..shared import cut


def sync_plan(artifacts: DataFrame, templates: DataFrame, end: str | None, as_of: str, chronological: bool = False) -> DataFrame:
    """For each managed dataset the window from its coverage's end to ``end`` (today, if null).

    Extent and box of the latest record are kept, its country code is not. A dataset without a
    template, or whose next period starts after the end, has no window.
    """
    rows = catalog.latest(artifacts).join(templates.select("dataset_id", "period_type"), "dataset_id", "left")
    known = F.col("period_type").isNotNull()
    start = F.when(known, periods.next_period_start(F.col("coverage_end"), F.col("period_type")))
    rows = rows.withColumns({"next_start": start, "sync_end": F.coalesce(F.lit(end), F.lit(as_of))})
    due = periods.is_due(F.col("next_start"), F.col("sync_end"), chronological)
    status = F.when(~known, "unknown").when(due, "due").otherwise("up_to_date")
    return rows.withColumn("status", status).withColumns({"start": F.when(F.col("status") == "due", F.col("next_start")), "end": F.when(F.col("status") == "due", F.col("sync_end"))})


def windows(plan: DataFrame, chunks: bool = False) -> DataFrame:
    """dataset_id, managed_id, ``_lo``, ``_hi`` and ``_box`` of what is due; with ``chunks``, a row for each ``time_chunk`` of the window."""
    box = F.col("bbox") if "bbox" in plan.columns else F.lit(None).cast(BBOX)
    managed = F.col("managed_id") if "managed_id" in plan.columns else F.col("dataset_id")
    lo, hi = periods.lower_bound(F.substring("start", 1, 13)), periods.upper_bound(F.col("end"))
    kind = ["period_type"] if chunks else []
    due = plan.where("status = 'due'").select("dataset_id", managed.alias("managed_id"), lo.alias("_lo"), hi.alias("_hi"), box.alias("_box"), *kind)
    if not chunks:
        return due
    chunk = lambda t: reduce(lambda out, k: F.when(F.col("period_type") == k, periods.time_chunk(t, k)).otherwise(out), periods.CHUNK_PERIODS, F.lit(0).cast("bigint"))
    return due.withColumn("time_chunk", F.explode(F.sequence(chunk(F.col("_lo")), chunk(F.col("_hi"))))).drop("period_type")


def in_box(box: str = "_box") -> Column:
    """Cell centres within a row's box, its border included, or any if it has none."""
    b = F.col(box)
    return b.isNull() | (F.col("lon").between(b["xmin"], b["xmax"]) & F.col("lat").between(b["ymin"], b["ymax"]))


def due_cells(landed: DataFrame, plan: DataFrame) -> DataFrame:
    """Landed cells within the window and the box of a managed dataset that is due, with its ``managed_id``.

    Landed cells that lie in folders by ``time_chunk`` meet the windows by chunk as well, so that other
    folders are not read.
    """
    by = ["dataset_id", "time_chunk"] if "time_chunk" in landed.columns else ["dataset_id"]
    met = landed.drop("managed_id").join(windows(plan, "time_chunk" in by), by)
    return met.where("time >= _lo and time < _hi").where(in_box()).drop("_lo", "_hi", "_box")


def incremental(stored: DataFrame, landed: DataFrame, plan: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """Landed cells within their dataset's due window and box that are not stored yet, by the given keys (``managed_id`` may be one)."""
    wanted = due_cells(landed, plan)
    wanted = wanted if "managed_id" in keys else wanted.drop("managed_id")
    return cells.append_missing(stored, wanted, keys, newest)


def apply(spark: SparkSession, root: str, landed: DataFrame, templates: DataFrame, end: str | None, as_of: str, name: str) -> bool:
    """Bring all managed datasets of a store up to date: their missing cells and a record of each appear at once.

    ``landed``: cells of template datasets, as schemas.LANDED. The store's cells are those of managed
    datasets. A dataset for which nothing has landed gets no record, so it stays due. False if ``name``
    is committed already.
    """
    if store.is_committed(spark, root, name):
        return False
    records = store.committed_records(spark, root)
    plan = cut(sync_plan(records, templates, end, as_of))
    due = due_cells(landed, plan).withColumn("dataset_id", F.col("managed_id")).select(schemas.LANDED.names)
    new = cut(store.additions(store.committed_cells(spark, root), due))
    reached = new.groupBy("dataset_id").agg(F.max("time").alias("_last")).withColumnRenamed("dataset_id", "managed_id")
    met = plan.join(reached, "managed_id")
    upto = periods.period_string(F.col("_last"), F.col("period_type"))
    made = met.select(
        (F.col("seq") + 1).alias("seq"), F.concat("managed_id", F.lit("@"), "end").alias("artifact_id"), "managed_id", "dataset_id", "extent_id", "bbox", "format", F.lit(as_of).cast("timestamp").alias("created_at"),
        F.col("start").alias("request_start"), F.col("end").alias("request_end"), "coverage_start", F.greatest("coverage_end", upto).alias("coverage_end"),
    )
    return store.commit(spark, root, name, new, made)
