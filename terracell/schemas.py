"""Explicit schemas of the tables that the operators read and write."""

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampNTZType, TimestampType


def _struct(**fields):
    return StructType([StructField(k, v) for k, v in fields.items()])


BBOX = _struct(xmin=DoubleType(), ymin=DoubleType(), xmax=DoubleType(), ymax=DoubleType())
REQUEST_SCOPE = _struct(start=StringType(), end=StringType(), extent_id=StringType(), bbox=BBOX)
COVERAGE = _struct(spatial=BBOX, temporal=_struct(start=StringType(), end=StringType()))
PUBLICATION = _struct(status=StringType(), collection_id=StringType(), published_at=TimestampType(), path=StringType())
CELLS = _struct(dataset_id=StringType(), time=TimestampNTZType(), lon=DoubleType(), lat=DoubleType(), value=DoubleType())
#: What lands: cells with their order of ingestion, which whoever lands them counts up.
LANDED = StructType([*CELLS.fields, StructField("ingested", LongType())])
#: Cells and records of a store's commits, and a line of its manifest.
COMMITTED = StructType([*LANDED.fields, StructField("time_chunk", LongType())])
RECORDS = _struct(seq=LongType(), artifact_id=StringType(), managed_id=StringType(), dataset_id=StringType(), extent_id=StringType(), bbox=BBOX, format=StringType(), created_at=TimestampType(), request_start=StringType(), request_end=StringType(), coverage_start=StringType(), coverage_end=StringType())
MANIFEST = _struct(n_cells=LongType(), n_records=LongType())
STORE = StructType([*CELLS.fields, *_struct(tile_y=LongType(), tile_x=LongType(), time_chunk=LongType()).fields])
TEMPLATES = _struct(id=StringType(), name=StringType(), short_name=StringType(), variable=StringType(), period_type=StringType(), units=StringType(), convert_units=StringType(), pre_process=ArrayType(StringType()), resolution=StringType(), source=StringType(), source_url=StringType(), default_params=MapType(StringType(), StringType()))
EXTENTS = _struct(id=StringType(), name=StringType(), description=StringType(), bbox=ArrayType(DoubleType()), country_code=StringType())
ARTIFACTS = _struct(
    seq=LongType(), artifact_id=StringType(), dataset_id=StringType(), dataset_name=StringType(), variable=StringType(), format=StringType(), path=StringType(),
    asset_paths=ArrayType(StringType()), variables=ArrayType(StringType()), request_scope=REQUEST_SCOPE, coverage=COVERAGE, created_at=TimestampType(), publication=PUBLICATION,
)
ZONES = _struct(zone_id=StringType(), name=StringType(), level=IntegerType(), parent_id=StringType(), ring=ArrayType(_struct(x=DoubleType(), y=DoubleType())))
STATIONS = _struct(id=LongType(), stn_id=LongType(), datetime=TimestampType(), value=DoubleType(), lat=DoubleType(), long=DoubleType())
