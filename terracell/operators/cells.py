"""Cells: reading them in, cutting out a part, what they cover, and how they are stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods
from .resolve import resolve_by_key

#: Names of the time axis, and pairs of names of the space axes, in order of precedence.
TIME_NAMES = ("valid_time", "time")
SPACE_NAMES = (("lon", "lat"), ("longitude", "latitude"), ("x", "y"))
SPATIAL_CHUNK = 256
KEY = ["dataset_id", "time", "lon", "lat"]


def with_axes(df: DataFrame) -> DataFrame:
    """Axis columns by their standard names; an error if an axis is missing."""
    time = next((c for c in TIME_NAMES if c in df.columns), None)
    space = next((p for p in SPACE_NAMES if p[1] in df.columns), None)
    if time is None or space is None or space[0] not in df.columns:
        raise ValueError(f"no {'time' if time is None else 'space'} axis among {df.columns}")
    return df.withColumnsRenamed({time: "time", space[0]: "lon", space[1]: "lat"})


def one_variable(df: DataFrame, variable: str) -> DataFrame:
    """Axes and one variable as ``value``; every other column goes. NaN is no value."""
    df = with_axes(df)
    keep = ["dataset_id"] if "dataset_id" in df.columns else []
    return df.select(*keep, "time", "lon", "lat", F.nanvl(F.col(variable).cast("double"), F.lit(None).cast("double")).alias("value"))


def without_nodata(df: DataFrame, nodata: float | None = None, include: bool = False) -> DataFrame:
    """Values equal to ``nodata`` become null, unless they are to be kept."""
    return df if include or nodata is None else df.withColumn("value", F.when(F.col("value") != nodata, F.col("value")))


def in_period(time: Column, start: str | None, end: str | None, strict: bool = False) -> Column:
    """Times from the start's first instant to the end's last; one bound alone counts only if ``strict``."""
    if not (strict or start and end):
        return F.lit(True)
    parts = [time >= periods.lower_bound(F.lit(start))] if start else []
    parts += [time < periods.upper_bound(F.lit(end))] if end else []
    return reduce(Column.__and__, parts, F.lit(True))


def in_bbox(bbox: tuple[float | None, ...] | None) -> Column:
    """Cell centres within the box, its border included, if all four bounds are given."""
    if bbox is None or any(b is None for b in bbox):
        return F.lit(True)
    xmin, ymin, xmax, ymax = bbox
    return F.col("lon").between(xmin, xmax) & F.col("lat").between(ymin, ymax)


def subset(df: DataFrame, start: str | None = None, end: str | None = None, bbox: tuple | None = None, strict: bool = False, period_type: str | None = None) -> DataFrame:
    """Cells of a period and a box. On a store, the range of time chunks follows, so that folders are skipped."""
    time = F.col("time")
    out = df.where(in_period(time, start, end, strict)).where(in_bbox(bbox))
    if period_type and "time_chunk" in df.columns and start and end:
        lo, hi = (periods.time_chunk(t, period_type) for t in (periods.lower_bound(F.lit(start)), periods.upper_bound(F.lit(end))))
        out = out.where(F.col("time_chunk").between(lo, hi))
    return out


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.orderBy("time", "lat", "lon").limit(n)


def coverage(df: DataFrame, period_type: Column | None = None, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Bounds in time and space of the stored cells, in one pass; as period strings if the type is known."""
    out = df.groupBy(*keys).agg(F.min("time").alias("t0"), F.max("time").alias("t1"), F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"))
    text = (lambda t: periods.period_string(t, period_type)) if period_type is not None else (lambda t: t)
    return out.select(*keys, text(F.col("t0")).alias("start"), text(F.col("t1")).alias("end"), "xmin", "ymin", "xmax", "ymax")


def with_coverage(templates: DataFrame, cov: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Templates with their coverage; null where nothing is stored."""
    return templates.join(cov, key, "left")


def mosaic(df: DataFrame, newest: list[Column], keys: list[str] = KEY) -> DataFrame:
    """Overlapping granules: of each cell and time, the row that was ingested last."""
    return resolve_by_key(df, keys, newest)


def with_layout(df: DataFrame, period_type: str, ix: Column, iy: Column, spatial: int = SPATIAL_CHUNK) -> DataFrame:
    """Chunk along time, and tiles along the axes."""
    return df.withColumns({"time_chunk": periods.time_chunk(F.col("time"), period_type), "tile_x": F.floor(ix / spatial).cast("bigint"), "tile_y": F.floor(iy / spatial).cast("bigint")})


def compact(df: DataFrame, path: str) -> None:
    """Write cells with a layout as a store: a folder for each dataset and chunk, tiles together.

    Cells are dealt to tasks by ranges of chunks and tiles, so that a large chunk is written by many tasks.
    """
    by = ["dataset_id", "time_chunk", "tile_y", "tile_x", "time"]
    (
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .write.partitionBy("dataset_id", "time_chunk").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    )


def append_missing(stored: DataFrame, landed: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """Landed cells that the store does not have; of a repeated key within one landing the first in the order ``newest`` counts."""
    return resolve_by_key(landed, keys, newest).join(stored.select(*keys), keys, "left_anti")


def by_parameters(df: DataFrame, variables: list[str] | None = None, stage: str = "final", version: str | None = None) -> DataFrame:
    """Granule rows of the wanted variables, product stage (none means final) and version, as far as these are columns."""
    if variables and "variable" in df.columns:
        df = df.where(F.col("variable").isin(variables))
    if "stage" in df.columns:
        df = df.where(F.coalesce("stage", F.lit("final")) == stage)
    return df.where(F.col("version") == version) if version and "version" in df.columns else df


def ingest(landed: DataFrame, stored: DataFrame | None, start: str, end: str | None, bbox: tuple | None, as_of: str, keys: list[str], newest: list[Column], overwrite: bool = False) -> DataFrame:
    """What a request adds: landed cells of its window (to today, if it names no end), new ones unless it overwrites."""
    wanted = subset(landed, start, end or as_of, bbox)
    if overwrite or stored is None:
        stored = wanted.limit(0)
    return append_missing(stored, wanted, keys, newest)


def open_cells(spark: SparkSession, store: str | None, granules: DataFrame | None, dataset_id: str) -> DataFrame:
    """The store's cells and those of granules that are newer than it; either alone if the other is missing."""
    kept = spark.read.parquet(store).where(F.col("dataset_id") == dataset_id).select(*KEY, "value") if store else None
    fresh = granules.where(F.col("dataset_id") == dataset_id).select(*KEY, "value") if granules is not None else None
    if kept is None or fresh is None:
        if kept is None and fresh is None:
            raise ValueError(f"nothing is stored of {dataset_id}")
        return fresh if kept is None else kept
    mark = kept.agg(F.max("time").cast("string").alias("mark")).first()["mark"]
    return kept.unionByName(fresh if mark is None else fresh.where(F.col("time") > F.lit(mark).cast("timestamp_ntz")))
