"""Readers of the engine's inputs."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..operators.cells import by_parameters
from ..shared import exists


def granules(spark: SparkSession, landing: str, dataset_id: str, variables: list[str] | None = None, stage: str = "final", version: str | None = None, static: tuple[str, ...] = ()) -> DataFrame:
    """Landed granules of exactly one dataset, by the id in their names (``{id}_{period}``), with ``granule`` and ``landed_at``.

    A granule is a file or a folder of files below the landing folder; granules may differ in their
    columns. Columns named in ``static`` do not change over time: a position has them from its first
    granule by name.
    """
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(landing)
    # What stands between the landing folder and the next slash, without an ending.
    below = F.substring_index(F.col("_metadata.file_path"), "/" + landing.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    granule = F.regexp_replace(F.regexp_extract(F.url_decode(below), r"^(?:granule=)?([^/]+)", 1), r"\.[A-Za-z]+$", "")
    df = df.withColumns({"granule": granule, "landed_at": F.col("_metadata.file_modification_time")})
    df = by_parameters(df.where(F.regexp_replace("granule", r"_\d[^_]*$", "") == dataset_id), variables, stage, version)
    if not static:
        return df
    first = df.groupBy("lon", "lat").agg(F.min(F.struct("granule", *static)).alias("_first"))
    return df.drop(*static).join(first, ["lon", "lat"]).select("*", *(F.col("_first")[c].alias(c) for c in static)).drop("_first")


def templates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Templates from lines of JSON, and the lines that are none."""
    schema = StructType([*schemas.TEMPLATES.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).where("trim(value) != ''")
    df = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("t"), "value")
    return df.where("t._bad is null").select("t.*").drop("_bad"), df.where("t._bad is not null").select("value")


def extents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Extents from lines of JSON, and the lines that are none: broken ones, and entries without an id.

    No file at all makes no extents.
    """
    schema = StructType([*schemas.EXTENTS.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).where("trim(value) != ''") if exists(spark, path) else spark.createDataFrame([], "value string")
    df = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"), "value")
    ok = F.col("e._bad").isNull() & F.col("e.id").isNotNull()
    return df.where(ok).select("e.*").drop("_bad"), df.where(~ok).select("value")


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Station observations from CSV, as cells."""
    df = spark.read.schema(schemas.STATIONS).csv(path, header=True)
    return df.select(F.concat(F.lit("station_"), F.col("stn_id").cast("string")).alias("dataset_id"), F.col("datetime").cast("timestamp_ntz").alias("time"), F.col("long").alias("lon"), "lat", "value")


def features(spark: SparkSession, path: str, id_property: str = "id", lines: bool = False) -> DataFrame:
    """Zones from GeoJSON collections of polygons and multipolygons, with all rings of each feature.

    A file holds one collection, or with ``lines`` a feature on each line, which tasks can share.
    ``properties`` and ``geometry`` are as they came, with values and coordinates as text. ``rings`` has the outer rings and the holes of every part, without a repeated last vertex, and
    ``ring`` the first one; a feature of another geometry has none.
    """
    feature = "id string, properties map<string,string>, geometry struct<type string, coordinates string>"
    if lines:
        f = spark.read.schema(feature).json(path)
    else:
        f = spark.read.schema(f"features array<struct<{feature}>>").json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    kind, nested = F.col("geometry.type"), F.col("geometry.coordinates")
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    parts = F.when(kind == "Polygon", F.from_json(nested, one)).when(kind == "MultiPolygon", F.flatten(F.from_json(nested, many)))
    f = f.withColumn("lines", F.transform(parts, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    rings = F.transform("lines", lambda r: F.when(r[0] == F.element_at(r, -1), F.slice(r, 1, F.size(r) - 1)).otherwise(r))
    get = lambda k: F.col("properties")[k]
    f = f.select(F.coalesce("id", get(id_property)).alias("zone_id"), get("name").alias("name"), get("level").try_cast("int").alias("level"), get("parent").alias("parent_id"), rings.alias("rings"), "properties", "geometry")
    return f.withColumn("ring", F.get("rings", F.lit(0)))


class Loaders:
    """Loaders by name: functions that return a DataFrame, or Spark data sources. One is called with those parameters that it takes."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Callable[..., DataFrame], set[str]]] = {}

    def add(self, name: str, loader: Callable[..., DataFrame]) -> None:
        self.known[name] = loader, set(signature(loader).parameters)

    def add_source(self, spark: SparkSession, source: type[DataSource], takes: set[str]) -> None:
        """A Python data source under its own name, with the options it takes."""
        spark.dataSource.register(source)

        def load(spark: SparkSession, **options) -> DataFrame:
            return spark.read.format(source.name()).options(**options).load()

        self.known[source.name()] = load, takes

    def load(self, name: str, spark: SparkSession, **params) -> DataFrame:
        if name not in self.known:
            raise ValueError(f"no loader {name}")
        loader, takes = self.known[name]
        return loader(spark, **{k: v for k, v in params.items() if k in takes})
