"""Expectations and properties on tiny tables."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terracell import fixtures as fx
from terracell import schemas
from terracell.functions import identity, periods
from terracell.operators import catalog, cells, export, series, zones
from terracell.plans import processes, sync
from terracell.sources import readers

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grid(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, time string, lon double, lat double, value double").withColumn("time", F.col("time").cast("timestamp_ntz"))


def record(seq, day, end, dataset="ds", extent="sle", status="published", collection=None):
    return (seq, str(seq), dataset, extent, None, day, end, {"status": status, "collection_id": collection})


RECORD = "seq bigint, artifact_id string, dataset_id string, extent_id string, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, created_at string, coverage_end string, publication struct<status:string,collection_id:string,published_at:timestamp,path:string>"


def records(spark, rows):
    df = spark.createDataFrame(rows, RECORD)
    return catalog.with_managed_id(df.withColumn("request_scope", F.struct(F.lit("2026-01-01").alias("start"), F.lit(None).cast("string").alias("end"), "extent_id", "bbox")))


def test_periods(spark):
    nxt = lambda p, k: one(spark, periods.next_period_start(F.lit(p), F.lit(k)))
    assert nxt("2024-01-31T23", "hourly") == "2024-02-01T00:00:00" and nxt("2024-12-31", "daily") == "2025-01-01"
    assert nxt("2024-12", "monthly") == "2025-01" and nxt("0999", "yearly") == "1000"
    for bad in ("weekly", None):
        with pytest.raises(Exception, match="not defined"):
            nxt("2024-01", bad)
    assert one(spark, periods.is_due(F.lit("2024-02-01T00:00:00"), F.lit("2024-02-01"))) is False
    assert one(spark, periods.is_due(F.lit("2024-02-01T00:00:00"), F.lit("2024-02-01"), chronological=True)) is True
    assert one(spark, periods.lower_bound(F.lit("nonsense"))) is None
    assert one(spark, periods.export_code(F.lit("2024-12-30").cast("timestamp_ntz"), "weekly")) == "2025W1"


def test_identity(spark):
    from zlib import adler32

    box = F.struct(*(F.lit(x).alias(s) for s, x in zip(identity.SIDES, (-13.5, 6.9, -10.1, 10.0))))
    none = F.lit(None).cast("string")
    text = "-13.500000,6.900000,-10.100000,10.000000"
    assert one(spark, identity.managed_id(F.lit("d"), F.lit(""), box)) == f"d_bbox_{adler32(text.encode()):08x}"
    assert one(spark, identity.managed_id(F.lit("d"), F.lit("sle"), box)) == "d_sle"
    assert one(spark, identity.managed_id(F.lit("d"), none, F.lit(None).cast(schemas.BBOX))) == "d_global"
    assert one(spark, identity.managed_id(F.lit("d"), F.lit("sle"), box, F.lit("own"))) == "own"
    assert one(spark, identity.parsed_bbox(F.lit("1,2,3"))) is None and one(spark, identity.parsed_bbox(F.lit("1,2,x,4"))) is None


def test_latest_record_makes_the_row(spark):
    df = records(spark, [record(1, "2026-02-01", "2026-01-31"), record(2, "2026-03-01", "2026-02-10"), record(3, "2026-03-01", "2026-02-11")])
    assert [(r["managed_id"], r["coverage_end"]) for r in catalog.latest(df).collect()] == [("ds_sle", "2026-02-10")]
    own = records(spark, [record(4, "2026-03-01", "x", collection="ds_sle"), record(5, "2026-03-02", "y", dataset="ds2"), record(6, "2026-01-01", "z", extent="")])
    every = df.unionByName(own)
    # Found by scope first, where ids are yet to be made: the same rows.
    assert sorted(catalog.latest(every.drop("managed_id")).select("managed_id", "seq").collect()) == sorted(catalog.latest(every).select("managed_id", "seq").collect())
    t = spark.createDataFrame([("other", "daily")], "dataset_id string, period_type string")
    assert catalog.described(df, t).first()["period_type"] == "unknown"
    # What a template says counts if it is text; internal ids and paths are not shown.
    t = spark.createDataFrame([("ds", "daily", 5, "mm")], "dataset_id string, period_type string, resolution int, units string")
    full = df.withColumns({"dataset_name": F.lit("D"), "variable": F.lit("v"), "path": F.lit("/secret"), "coverage": F.lit(None).cast(schemas.COVERAGE)})
    row = catalog.datasets(full, t).first()
    assert (row["dataset_id"], row["source_dataset_id"], row["period_type"], row["units"], row["resolution"], row["publication"]["status"]) == ("ds_sle", "ds", "daily", "mm", None, "published")
    assert set(row.asDict()) == {"dataset_id", "source_dataset_id", "dataset_name", "variable", *catalog.DESCRIBED, "extent", "last_updated", "publication"} and len(row["publication"]) == 2


@pytest.mark.parametrize("end,status,window", [("2026-01-31", "up_to_date", (None, None)), ("2026-02-10", "due", ("2026-02-01", "2026-02-10"))])
def test_sync_plan(spark, end, status, window):
    t = spark.createDataFrame([("ds", "daily")], "dataset_id string, period_type string")
    r = sync.sync_plan(records(spark, [record(1, "2026-02-01", "2026-01-31")]), t, end, "2030-01-01").first()
    assert r["status"] == status and (r["start"], r["end"]) == window and r["extent_id"] == "sle"


def test_incremental_twice_adds_nothing(spark):
    stored = grid(spark, [("ds", "2026-01-31", 0.0, 0.0, 1.0)])
    landed = grid(spark, [("ds", f"2026-02-{d:02d}", 0.0, 0.0, float(d)) for d in range(1, 15)] + [("ds", "2026-02-01", 0.0, 0.0, 1.0)])
    t = spark.createDataFrame([("ds", "daily")], "dataset_id string, period_type string")
    due = sync.sync_plan(records(spark, [record(1, "2026-02-01", "2026-01-31")]), t, "2026-02-10", "2030-01-01")
    add = lambda have: sync.incremental(have, landed, due, cells.KEY, [F.desc("value")])
    added = add(stored)
    assert added.count() == 10 and add(stored.unionByName(added)).count() == 0


def test_axes_and_subset(spark):
    df = grid(spark, [("d", "2024-01-01", 0.0, 0.0, float("nan")), ("d", "2024-01-31 23:00:00", 1.0, 1.0, 2.0), ("d", "2024-02-01", 1.0, 1.0, 3.0)])
    named = df.withColumnsRenamed({"time": "valid_time", "lon": "longitude", "lat": "latitude", "value": "t2m"})
    assert [r["value"] for r in cells.one_variable(named, "t2m").collect()] == [None, 2.0, 3.0]
    with pytest.raises(ValueError):
        cells.with_axes(df.drop("lat"))
    assert cells.subset(df, "2024-01", "2024-01").count() == 2 and cells.subset(df, "2024-02").count() == 3 and cells.subset(df, "2024-02", strict=True).count() == 1
    assert cells.subset(df, bbox=(1.0, 1.0, 1.0, None)).count() == 3 and cells.subset(df, bbox=(0.5, 0.5, 1.0, 1.0)).count() == 2


def test_store(spark, tmp_path):
    c = cells.with_layout(fx.daily_cells(spark, SF), "daily", F.col("ix"), F.col("iy"), spatial=8).drop("ix", "iy", "granule", "line")
    path = str(tmp_path / "store")
    cells.compact(c, path)
    back = spark.read.parquet(path)
    assert back.select(*cells.KEY, "value").exceptAll(c.select(*cells.KEY, "value")).isEmpty() and back.count() == c.count()
    part = cells.subset(back.where("dataset_id = 'grid_daily'"), "1996", "1996", period_type="daily")
    text = plan(part)
    assert "PartitionFilters: [isnotnull" in text and "time_chunk" in text and "PushedFilters: [IsNotNull(time)" in text
    assert part.count() == cells.subset(c, "1996", "1996").count()
    assert cells.open_cells(spark, path, c, "grid_daily").count() == c.count()
    with pytest.raises(ValueError):
        cells.open_cells(spark, None, None, "x")


def test_granules_by_exact_id(spark, tmp_path):
    for name in ("a_2024-01", "a_modified_2024-01", "a_2024-02"):
        grid(spark, [(name, "2024-01-01", 0.0, 0.0, 1.0)]).coalesce(1).write.parquet(str(tmp_path / "x" / name))
        import shutil

        (tmp_path / "landing").mkdir(exist_ok=True)
        shutil.copy(next((tmp_path / "x" / name).glob("part*")), tmp_path / "landing" / f"{name}.parquet")
    assert readers.granules(spark, str(tmp_path / "landing"), "a").count() == 2


def test_coverage_is_within_the_request(spark):
    r = cells.coverage(cells.subset(fx.daily_cells(spark, SF), "1996", "1999", (-13.0, 8.0, -11.0, 9.8)), F.lit("daily")).first()
    assert "1996" <= r["start"] <= r["end"] < "2000" and -13 <= r["xmin"] <= r["xmax"] <= -11


def test_zone_join_has_no_nested_loop(spark):
    z = zones.zonal_statistics(fx.daily_cells(spark, SF), fx.nation_zones(spark, SF), ("count", "sum"))
    assert "NestedLoop" not in plan(z) and "Cartesian" not in plan(z)
    whole = z.agg(F.sum("count")).first()[0]
    half = [zones.zonal_statistics(fx.daily_cells(spark, SF), fx.nation_zones(spark, SF).where(f"crc32(zone_id) % 2 = {k}"), ("count",)).agg(F.sum("count")).first()[0] for k in (0, 1)]
    assert whole == sum(half)
    with pytest.raises(ValueError):
        zones.zonal_statistics(fx.daily_cells(spark, SF), z, ("mode",))
    with pytest.raises(ValueError):
        zones.attribute_filter(fx.zones(spark, SF), "secret = 1")
    assert zones.nested(z, "stats", ("count", "sum")).first()["stats"]["count"] >= 0


def test_attribute_filter_texts_and_dates(spark):
    rows = [("a", "It's", "2019-05-01"), ("b", "50% \\\\ off", "2021-05-01"), ("c", "x'; DROP", None)]
    z = spark.createDataFrame(rows, "zone_id string, name string, openingDate string").withColumn("openingDate", F.col("openingDate").cast("date"))
    got = lambda text: sorted(r["zone_id"] for r in zones.attribute_filter(z, text).collect())
    assert got("name = 'It''s'") == ["a"] and got("name LIKE '%''%'") == ["a", "c"] and got("name = 'x''; DROP'") == ["c"]
    assert got("openingDate >= DATE '2020-01-01'") == ["b"] and got("openingDate < DATE('2020-01-01') OR openingDate IS NULL") == ["a", "c"]
    assert got("name = '50% \\\\ off'") == ["b"]
    for bad in ("secret = 1", "name = 'a' OR exists(select 1)", "upper(name) = 'A'"):
        with pytest.raises(ValueError):
            got(bad)


def test_processes(spark, tmp_path):
    square = lambda x, n: [[x, 0], [x + n, 0], [x + n, n], [x, n], [x, 0]]
    fs = [
        {"type": "Feature", "id": "A", "properties": {"name": 'He said "no"', "out": "old"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 2)]}},
        {"type": "Feature", "properties": {"code": "B"}, "geometry": {"type": "Polygon", "coordinates": [square(10, 1)]}},
        {"type": "Feature", "id": "P", "properties": None, "geometry": {"type": "Point", "coordinates": [1, 1]}}, {"type": "Feature", "id": "N", "geometry": None},
    ]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    f = readers.features(spark, str(tmp_path / "f.json"), "code")
    c = grid(spark, [("d", "2024-01-01", 0.5, 0.5, 1.0), ("d", "2024-01-01", 1.5, 1.5, 5.0), ("d", "2024-01-02", 1.5, 1.5, -9.0), ("d", "2024-01-01", 5.0, 5.0, 7.0)])
    run = lambda **k: {r["zone_id"]: json.loads(r["feature"]) for r in processes.zonal_process(f, c, ("count", "sum"), "out", **k).collect()}
    got = run(nodata=-9.0)
    assert got["A"] == {"type": "Feature", "id": "A", "properties": {"name": 'He said "no"', "out": {"count": 2, "sum": 6.0}}, "geometry": fs[0]["geometry"]}
    assert got["B"]["properties"] == {"code": "B", "out": {"count": 0, "sum": None}} and got["B"]["id"] == "B"
    assert got["P"]["properties"] == {"out": {"count": 0, "sum": None}} and got["P"]["geometry"] == fs[2]["geometry"] and got["N"]["geometry"] is None
    assert run(nodata=-9.0, include_nodata=True)["A"]["properties"]["out"] == {"count": 3, "sum": -3.0}
    one = processes.zonal_process(f, c).where("zone_id = 'A'").first()["feature"]
    assert json.loads(one)["properties"]["zonal_statistics"] == {"mean": -1.0}
    units = f.where("rings is not null").withColumn("level", F.lit(3))
    values = [json.loads(r[0]) for r in processes.aggregation_process(units, c, "2024-01", "2024-01", "E", level=3, resolution="daily").collect()]
    assert sorted((v["orgUnit"], v["period"], v["value"]) for v in values) == [("A", "20240101", 3.0), ("A", "20240102", -9.0)]
    assert processes.aggregation_process(units, c, "2024-01", "2024-01", "E", level=9).count() == 0
    # The box and the period reach the scan.
    c.write.parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    text = plan(cells.subset(stored, "2024-01", "2024-01", tuple(zones.bounds(units).first())))
    assert "<= 11.0" in text and "PushedFilters: [IsNotNull(time), IsNotNull(lon), IsNotNull(lat), GreaterThanOrEqual(time" in text


def test_series(spark):
    h = grid(spark, [("d", f"2024-01-{1 + k // 24:02d} {k % 24:02d}:00:00", 0.0, 0.0, 1.0) for k in range(1, 60)])
    assert series.resample(h, "daily").agg(F.sum("value")).first()[0] == 59
    with pytest.raises(ValueError):
        series.convert_units(h, "m", "K")
    with pytest.raises(ValueError):
        series.processed(h, ["unknown"])
    assert series.processed(h, ["resample_daily"]).count() == 3
    with pytest.raises(ValueError):
        export.write_subset(h, "x", "netcdf")


def test_export_leaves_out_nulls(spark):
    v = grid(spark, [("d", "2024-01-01", 0.0, 0.0, 1.5)]).select(F.col("time").alias("period"), F.lit("U").alias("zone_id"), "value")
    assert json.loads(export.data_values(v, "E", "monthly").first()[0]) == {"dataElement": "E", "period": "202401", "orgUnit": "U", "value": 1.5}
    assert "categoryOptionCombo" in export.data_values(v, "E", "daily", "C").first()[0]


def test_readers(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id": "a", "period_type": "daily"}\n{broken\n')
    good, bad = readers.templates(spark, str(tmp_path / "t.json"))
    assert [r["id"] for r in good.collect()] == ["a"] and bad.count() == 1
    (tmp_path / "e.json").write_text('{"id": "a", "bbox": [1, 2, 3, 4], "country_code": "X"}\n{"name": "none"}\n{"id": "b", "bbox": [1]}\n')
    (tmp_path / "e.json").open("a").write("[broken\n")
    known, stray = readers.extents(spark, str(tmp_path / "e.json"))
    assert sorted(r["value"] for r in stray.collect()) == ["[broken", '{"name": "none"}']
    assert all(df.count() == 0 for df in readers.extents(spark, str(tmp_path / "missing.json")))
    ok, lost = catalog.valid_extents(known)
    assert [r["id"] for r in ok.collect()] == ["a"] and "country_code" not in ok.columns and [r["id"] for r in lost.collect()] == ["b"]
    (tmp_path / "o.csv").write_text("id,stn_id,datetime,value,lat,long\n1,35,2001-10-30T14:24:55Z,89.9,45,-75\n")
    r = readers.stations(spark, str(tmp_path / "o.csv")).first()
    assert (r["dataset_id"], r["lon"], r["value"]) == ("station_35", -75.0, 89.9)
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"properties": {"code": "Z", "level": "2"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    z = readers.features(spark, str(tmp_path / "f.json"), "code").first()
    assert z["zone_id"] == "Z" and len(z["ring"]) == 3 and len(z["rings"]) == 1
    square = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
    many = {"features": [{"id": "M", "geometry": {"type": "MultiPolygon", "coordinates": [[square(0, 0, 4), square(1, 1, 2)], [square(6, 0, 1)]]}}, {"id": "P", "geometry": {"type": "Polygon", "coordinates": [square(0, 6, 4), square(1, 7, 2)]}}, {"id": "N", "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "m.json").write_text(json.dumps(many))
    z = readers.features(spark, str(tmp_path / "m.json"))
    assert {r["zone_id"]: r["rings"] and len(r["rings"]) for r in z.collect()} == {"M": 3, "P": 2, "N": None}
    at = grid(spark, [("d", "2024-01-01", x, y, 1.0) for x, y in ((0.5, 0.5), (2.0, 2.1), (6.5, 0.5), (5.0, 0.5), (0.5, 6.5), (2.0, 8.1))])
    assert sorted((r["zone_id"], r["lon"], r["lat"]) for r in zones.cells_in_zones(at, z.where("rings is not null")).collect()) == [("M", 0.5, 0.5), ("M", 6.5, 0.5), ("P", 0.5, 6.5)]
    (tmp_path / "l.json").write_text("\n".join(json.dumps(f) for f in many["features"]))
    assert readers.features(spark, str(tmp_path / "l.json"), lines=True).drop("properties").exceptAll(z.drop("properties")).isEmpty()
    loaders = readers.Loaders()
    loaders.add("n", lambda spark, start: spark.range(start))
    assert loaders.load("n", spark, start=3, bbox=None).count() == 3
    loaders.add_source(spark, Ramp, {"rows", "start"})
    assert sorted(r["at"] for r in loaders.load("ramp", spark, rows=5, start=7, bbox="1,2,3,4").collect()) == [7, 8, 9, 10, 11]
    with pytest.raises(ValueError):
        loaders.load("m", spark)


class Ramp(DataSource):
    """Numbers from ``start``, two partitions of them; an option that it does not take is an error."""

    @classmethod
    def name(cls):
        return "ramp"

    def schema(self):
        return "at bigint"

    def reader(self, schema):
        return RampReader(dict(self.options))


class RampReader(DataSourceReader):
    def __init__(self, options):
        assert set(options) == {"rows", "start"}
        self.rows, self.start = int(options["rows"]), int(options["start"])

    def partitions(self):
        return [InputPartition(0), InputPartition(1)]

    def read(self, partition):
        for k in range(partition.value, self.rows, 2):
            yield (self.start + k,)


def test_requests(spark):
    r = spark.createDataFrame([(1, None, None), (2, None, "SLE")], "id int, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, country_code string")
    ok, lost = catalog.spatial_arguments(r, default_bbox="1,2,3,4")
    assert [x["id"] for x in ok.collect()] == [2] and lost.first()["reason"] == "no country code"
    assert catalog.spatial_arguments(r, default_country="X")[1].first()["reason"] == "no bounding box"
    assert catalog.spatial_arguments(r, default_country="X", bounds=(0, 0, 1, 1))[0].count() == 2


def test_dedup_lookup_of_all_rows_makes_no_pairs(spark):
    rows = [(i, f"ds_{i % 3}", None if i % 3 == 0 else f"e{i % 2}", "zarr" if i % 5 else "netcdf") for i in range(600)]
    a = spark.createDataFrame(rows, "seq bigint, dataset_id string, extent_id string, format string")
    out = catalog.dedup_lookup(a, a.withColumnRenamed("seq", "request_id"), ["extent_id"], prefer_zarr=True)
    newest = {(d, e): i for i, d, e, f in rows if f == "zarr"}
    assert sorted(tuple(r) for r in out.collect()) == sorted((i, newest[d, e]) for i, d, e, _ in rows if (d, e) in newest)
    optimized = out._jdf.queryExecution().optimizedPlan().toString()
    assert "max(seq" in optimized[optimized.index("Join") :]


def test_newest_of_a_landing_counts(spark):
    rows = [("d", "2024-01-01", 0.0, 0.0, float(v)) for v in (2, 9, 4)] + [("d", "2024-01-02", 0.0, 0.0, 5.0)]
    landed, stored = grid(spark, rows), grid(spark, [("d", "2024-01-02", 0.0, 0.0, 1.0)])
    assert [r["value"] for r in cells.append_missing(stored, landed, cells.KEY, [F.desc("value")]).collect()] == [9.0]
    assert [r["value"] for r in cells.append_missing(stored, landed, cells.KEY, [F.asc("value")]).collect()] == [2.0]


def test_subtree_of_any_depth(spark):
    chain = [(f"z{i}", f"z{i - 1}" if i else None) for i in range(15)]
    z = spark.createDataFrame(chain, "zone_id string, parent_id string")
    assert zones.subtree(z, "z0").count() == 15 and zones.subtree(z, "z14").count() == 1
    with pytest.raises(Exception, match="below itself"):
        zones.subtree(z.union(spark.createDataFrame([("z1", "z3")], z.schema)), "z1").collect()
    deep = spark.createDataFrame([(f"z{i}", f"z{i - 1}" if i else None) for i in range(104)], z.schema)  # more than Spark allows by default
    assert zones.subtree(deep, "z0").count() == 104
    with pytest.raises(Exception, match="below itself"):
        zones.subtree(spark.createDataFrame([("a", "a")], z.schema), "a").collect()
    # A unit with two units above it, both below the root, is one row.
    both = spark.createDataFrame([("r", None), ("p", "r"), ("q", "r"), ("x", "p"), ("x", "q")], z.schema)
    assert sorted(r["zone_id"] for r in zones.subtree(both, "r").select("zone_id").distinct().collect()) == ["p", "q", "r", "x"]
    with pytest.raises(ValueError):
        zones.fields(z, ["secret"])
    assert zones.fields(z, ["parent_id"], "z3").first()["parent_id"] == "z2"


def test_units_by_row_must_be_known(spark):
    df = spark.createDataFrame([(1.0, "kelvin", "mm")], "value double, units string, convert_units string")
    with pytest.raises(Exception, match="no conversion"):
        series.convert_by_row(df, series.conversions(spark)).collect()
    assert series.template_steps({"pre_process": ["a"], "units": "m", "convert_units": "mm"}) == ["a", ("convert_units", "m", "mm")] and series.template_steps({}) == []


def test_publication(spark):
    df = records(spark, [record(1, "2026-02-01", "x", status="unpublished"), record(2, "2026-02-01", "y", collection="own")])
    p = {r["seq"]: r["publication"] for r in catalog.published(df, F.lit("2026-03-01")).collect()}
    assert p[1]["status"] == "published" and p[1]["path"] == "/ogcapi/collections/ds_sle" and p[2]["published_at"] is None
    old = spark.createDataFrame([(None, ((1.0, 2.0, 3.0, 4.0), ("2020", "2021"))), (None, None)], f"request_scope {schemas.REQUEST_SCOPE.simpleString()}, coverage {schemas.COVERAGE.simpleString()}")
    up = catalog.upgraded(old).collect()
    assert up[0]["request_scope"]["start"] == "2020" and up[0]["request_scope"]["bbox"]["xmax"] == 3.0 and up[1]["request_scope"] is None


def test_one_file_is_cut_out_by_many_tasks(spark, tmp_path):
    """The task that writes the file does not read the table."""
    from pyspark import TaskContext

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        read.add(1 << TaskContext.get().partitionId())
        yield from batches

    h = grid(spark, [("d", f"2024-01-{d:02d}", float(d), 0.0, 1.0) for d in range(1, 29)]).repartition(4, "lon").mapInPandas(seen, schemas.CELLS)
    export.write_subset(h, str(tmp_path / "x"), "csv", one_file=True)
    assert read.value == 0b1111
    back = spark.read.schema(schemas.CELLS).option("header", True).csv(str(tmp_path / "x"))
    assert len(list((tmp_path / "x").glob("part-*"))) == 1 and sorted(r["lon"] for r in back.collect()) == [float(d) for d in range(1, 29)]
