"""The driver's tables seen as cells, artifacts, templates, zones and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.series import sums_in_order

#: Corners of a shape's outer ring, its hole, and its other part, from the north-west corner of its field.
SHAPE = ((("113e-4", "97e-4"), ("4719e-4", "631e-4"), ("4127e-4", "4533e-4"), ("871e-4", "3917e-4")), (("1571e-4", "1333e-4"), ("3119e-4", "1217e-4"), ("2399e-4", "2903e-4")), (("5231e-4", "1019e-4"), ("6791e-4", "3529e-4"), ("4943e-4", "5717e-4")))
LON0, LAT0, STEP = -13.5, 10.0, 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily raster: one row for each line of an order, overlaps included."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'grid_daily' AS dataset_id", "l_shipdate AS time", "l_partkey % 68 AS ix", "l_suppkey % 62 AS iy",
        "-13.5e0 + (l_partkey % 68) * 5e-2 AS lon", "10e0 - (l_suppkey % 62) * 5e-2 AS lat", "l_quantity AS value", "l_orderkey AS granule", "l_linenumber AS line",
    )


def hourly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly series for each user."""
    return _events(spark, sf_dir).groupBy("dataset_id", "time", "lon", "lat").agg(F.sum("value").alias("value"))


def hourly_cells_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``seq``, an hour's first event; values are added up by the order of events."""
    return sums_in_order(_events(spark, sf_dir, "event_id AS seq"), ["dataset_id", "time", "lon", "lat"], ["seq"])


def _events(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("'series_hourly' AS dataset_id", "cast(date_trunc('hour', ts) AS timestamp_ntz) AS time", "cast(user_id AS double) AS lon", "0e0 AS lat", "value", *more)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = "CASE WHEN o_orderpriority LIKE '3%' THEN named_struct('xmin', (o_custkey % 4) - 13.5e0, 'ymin', 6.9e0, 'xmax', (o_custkey % 4) - 12.5e0, 'ymax', 10e0) END"
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq", "cast(o_orderkey AS string) AS artifact_id", "concat('ds_', o_custkey % 50) AS dataset_id", "concat('Dataset ', o_custkey % 50) AS dataset_name", "'v' AS variable",
        "CASE WHEN o_orderpriority LIKE '1%' THEN 'ext_a' WHEN o_orderpriority LIKE '2%' THEN 'ext_b' END AS extent_id", f"{box} AS bbox",
        "CASE WHEN o_orderstatus = 'P' THEN 'netcdf' ELSE 'zarr' END AS format", "o_orderstatus = 'F' AS is_published", "o_orderdate AS created_at",
        "element_at(array('hourly', 'daily', 'monthly', 'yearly'), cast(o_custkey % 50 % 4 + 1 AS int)) AS own_type",
    )
    from .functions.periods import period_string

    df = df.withColumn("coverage_end", period_string(F.col("created_at"), F.col("own_type")))
    df = df.withColumn("request_scope", F.struct(F.lit("1995-01-01").alias("start"), F.lit(None).cast("string").alias("end"), "extent_id", "bbox"))
    df = df.withColumn("coverage", F.struct(F.col("bbox").alias("spatial"), F.struct(F.lit("1995-01-01").alias("start"), F.col("coverage_end").alias("end")).alias("temporal")))
    status = F.when(F.col("is_published"), "published").otherwise("unpublished")
    none = F.lit(None).cast("string")
    return df.withColumn("publication", F.struct(status.alias("status"), none.alias("collection_id"), F.lit(None).cast("timestamp").alias("published_at"), none.alias("path")))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each dataset id but those that end in 48 or 49."""
    ids = table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 AS k").distinct().where("k < 48")
    return ids.selectExpr("concat('ds_', k) AS dataset_id", "concat('Short ', k) AS short_name", "element_at(array('hourly', 'daily', 'monthly', 'yearly'), cast(k % 4 + 1 AS int)) AS period_type", "k AS position")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as zones of the shape of an L, regions above them without a ring of their own, and a root."""
    n = table(spark, sf_dir, "nation").selectExpr("*", "-13.525e0 + (n_nationkey % 5) * 7e-1 AS x0", "10.025e0 - floor(n_nationkey / 5) * 6e-1 AS y1")
    corners = [("0e0", "0e0"), ("7e-1", "0e0"), ("7e-1", "3e-1"), ("35e-2", "3e-1"), ("35e-2", "6e-1"), ("0e0", "6e-1")]
    ring = "array(" + ", ".join(f"named_struct('x', x0 + {a}, 'y', y1 - {b})" for a, b in corners) + ")"
    none = "cast(null AS array<struct<x:double,y:double>>)"
    nations = n.selectExpr("concat('N', n_nationkey) AS zone_id", "n_name AS name", "3 AS level", "concat('R', n_regionkey) AS parent_id", f"{ring} AS ring")
    regions = table(spark, sf_dir, "region").selectExpr("concat('R', r_regionkey) AS zone_id", "r_name AS name", "2 AS level", "'ROOT' AS parent_id", f"{none} AS ring")
    root = table(spark, sf_dir, "region").selectExpr("'ROOT' AS zone_id", "'World' AS name", "1 AS level", "cast(null AS string) AS parent_id", f"{none} AS ring").distinct()
    return root.unionByName(regions).unionByName(nations)


def nation_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones(spark, sf_dir).where("level = 3")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with slanted sides, a hole and a second part, one for each nation."""
    n = table(spark, sf_dir, "nation").selectExpr("*", "-13.525e0 + (n_nationkey % 5) * 7e-1 AS x0", "10.025e0 - floor(n_nationkey / 5) * 6e-1 AS y1")
    ring = lambda corners: "array(" + ", ".join(f"named_struct('x', x0 + {a}, 'y', y1 - {b})" for a, b in corners) + ")"
    return n.selectExpr("concat('S', n_nationkey) AS zone_id", f"array({', '.join(map(ring, SHAPE))}) AS rings")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones without their rings, and customers as units below the nations."""
    c = table(spark, sf_dir, "customer").selectExpr("concat('C', c_custkey) AS zone_id", "c_name AS name", "4 AS level", "concat('N', c_nationkey) AS parent_id")
    return zones(spark, sf_dir).drop("ring").unionByName(c)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS point_id", "-13.5e0 + (s_suppkey % 68) * 5e-2 + 1e-2 AS lon", "10e0 - (s_suppkey % 62) * 5e-2 + 1e-2 AS lat")
