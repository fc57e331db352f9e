"""Whole processes over features and a raster: statistics of each feature, and data values of units."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cells, export, zones


def with_property(properties: Column, name: str, value: Column) -> Column:
    """JSON of a map of properties with one more, a struct; one of that name gives way."""
    rest = F.to_json(F.map_filter(properties, lambda k, v: k != name))
    own = F.concat(F.lit(json.dumps(name) + ":"), F.to_json(value, {"ignoreNullFields": "false"}))
    return F.when(F.coalesce(rest, F.lit("{}")) == "{}", F.concat(F.lit("{"), own, F.lit("}"))).otherwise(F.concat(F.substring(rest, 1, F.length(rest) - 1), F.lit(","), own, F.lit("}")))


def zonal_process(
    features: DataFrame, raster: DataFrame, stats: tuple[str, ...] = ("mean",), output_property: str = "zonal_statistics",
    all_touched: tuple[float, float] | None = None, include_nodata: bool = False, nodata: float | None = None,
) -> DataFrame:
    """Each feature as it came, with the statistics of the raster's values in it under one property.

    ``features``: what ``readers.features`` returns. The result has ``zone_id`` and ``feature``, GeoJSON text.
    A feature without an area, or without a value in it, has a count of 0 and otherwise null statistics.
    """
    areas = features.where("rings is not null").select("zone_id", "rings")
    values = cells.without_nodata(raster, nodata, include_nodata)
    made = zones.nested(zones.zonal_statistics(values, areas, stats), "_stats", stats)
    met = features.join(made, "zone_id", "left")
    zero = F.struct(*((F.coalesce(F.col(f"_stats.{s}"), F.lit(0)) if s == "count" else F.col(f"_stats.{s}")).alias(s) for s in stats))
    feature = F.concat(
        F.lit('{"type":"Feature","id":'), F.when(F.col("zone_id").isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(F.col("zone_id").alias("v"))), r'^\{"v":(.*)\}$', 1)),
        F.lit(',"properties":'), with_property(F.col("properties"), output_property, zero),
        F.lit(',"geometry":'), F.coalesce(F.concat(F.lit('{"type":"'), F.col("geometry.type"), F.lit('","coordinates":'), F.col("geometry.coordinates"), F.lit("}")), F.lit("null")), F.lit("}"),
    )
    return met.select("zone_id", feature.alias("feature"))


def aggregation_process(
    units: DataFrame, raster: DataFrame, start: str, end: str, data_element: str, level: int | None = None, parent: str | None = None, ids: list[str] | None = None,
    resolution: str = "monthly", spatial: str = "mean", temporal: str = "sum", category: str | None = None, attribute: str | None = None,
) -> DataFrame:
    """Data values of the chosen units: the raster over their union's box and the period, reduced over each unit, then over time.

    The box is four numbers of the units' bounds; as literals, they reach the raster's scan.
    """
    chosen = zones.select_zones(units, level, parent, ids)
    box = zones.bounds(chosen).first()
    inside = cells.subset(raster, start, end, tuple(box) if box["xmin"] is not None else None)
    return export.data_values(zones.unit_values(inside, chosen, resolution, spatial, temporal), data_element, resolution, category, attribute)
