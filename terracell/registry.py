"""The registered queries of the gridded-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import schemas
from .functions import identity, periods
from .operators import catalog, cells, export, series, store, zones
from .plans import ingestion, processes, sync
from .shared import cut, delete, new_folder
from .sources import readers
from .streaming.sync import stream_sync

AS_OF = "2001-06-30"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_CELLS = """cells AS (SELECT 'grid_daily' AS dataset_id, l_shipdate AS time, l_partkey % 68 AS ix, l_suppkey % 62 AS iy,
  -13.5e0 + (l_partkey % 68) * 5e-2 AS lon, 10e0 - (l_suppkey % 62) * 5e-2 AS lat, l_quantity AS value, l_orderkey AS granule, l_linenumber AS line FROM lineitem)"""
_HOURLY = """hourly AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS time, user_id::DOUBLE AS lon, sum(value) AS value FROM events GROUP BY ALL)"""
_TYPE = "list_extract(['hourly', 'daily', 'monthly', 'yearly'], (o_custkey % 50 % 4 + 1)::INT)"
_PERIOD = "CASE {p} WHEN 'hourly' THEN strftime({t}, '%Y-%m-%dT%H') WHEN 'daily' THEN strftime({t}, '%Y-%m-%d') WHEN 'monthly' THEN strftime({t}, '%Y-%m') ELSE strftime({t}, '%Y') END"
_BOX_TEXT = "printf('%.6f,%.6f,%.6f,%.6f', (o_custkey % 4) - 13.5e0, 6.9e0, (o_custkey % 4) - 12.5e0, 10e0)"


def _adler(text: str) -> str:
    a = f"list_transform(range(0, length({text}) + 1), lambda n: (1 + list_sum(list_transform(range(1, n + 1), lambda i: ord(substr({text}, i, 1)))))::BIGINT % 65521)"
    return f"(SELECT printf('%08x', ((list_sum(z[2:]) % 65521) * 65536 + z[-1])::BIGINT) FROM (SELECT list_transform({a}, lambda x: coalesce(x, 1)) AS z))"


_ARTIFACTS = f"""boxes AS (SELECT bk, {_adler('t')} AS hash FROM (SELECT DISTINCT o_custkey % 4 AS bk, {_BOX_TEXT} AS t FROM orders)),
base AS (SELECT o_orderkey AS seq, 'ds_' || (o_custkey % 50) AS dataset_id, o_custkey % 50 AS k,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'ext_a' WHEN o_orderpriority LIKE '2%' THEN 'ext_b' END AS extent_id,
  CASE WHEN o_orderpriority LIKE '3%' THEN o_custkey % 4 END AS box,
  CASE WHEN o_orderstatus = 'P' THEN 'netcdf' ELSE 'zarr' END AS format, o_orderstatus = 'F' AS is_published, o_orderdate AS created_at,
  {_PERIOD.format(t='o_orderdate', p=_TYPE)} AS coverage_end FROM orders),
artifacts AS (SELECT base.*, dataset_id || '_' || coalesce(extent_id, 'bbox_' || hash, 'global') AS managed_id,
  CASE WHEN k < 48 THEN list_extract(['hourly', 'daily', 'monthly', 'yearly'], (base.k % 4 + 1)::INT) END AS period_type
  FROM base LEFT JOIN boxes ON base.box = boxes.bk),
latest AS (SELECT * FROM artifacts QUALIFY row_number() OVER (PARTITION BY managed_id ORDER BY created_at DESC, seq) = 1)"""
_ZONES = """zones AS (SELECT n_nationkey AS k, 'N' || n_nationkey AS zone_id, n_name AS name, -13.525e0 + (n_nationkey % 5) * 7e-1 AS x0, 10.025e0 - (n_nationkey // 5) * 6e-1 AS y1 FROM nation),
corners(i, a, b) AS (VALUES (0, 0e0, 0e0), (1, 7e-1, 0e0), (2, 7e-1, 3e-1), (3, 35e-2, 3e-1), (4, 35e-2, 6e-1), (5, 0e0, 6e-1)),
edges AS (SELECT zone_id, x0 + p.a AS x1, y1 - p.b AS y1, x0 + q.a AS x2, y1 - q.b AS y2 FROM zones, corners p JOIN corners q ON q.i = (p.i + 1) % 6)"""
_INSIDE = """positions AS (SELECT DISTINCT lon, lat FROM cells),
inside AS (SELECT zone_id, lon, lat FROM positions, edges WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_managed_id(fx.artifacts(spark, sf_dir))


@contextmanager
def _folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder that executors and driver share; it is deleted once the query's rows are kept elsewhere."""
    path = new_folder(spark, name)
    try:
        yield path
    finally:
        delete(spark, path)


def _monthly(df: DataFrame, n: str = "added") -> DataFrame:
    return df.groupBy(F.date_format("time", "yyyy-MM").alias("month")).agg(F.count("*").alias(n), F.sum("value").alias("total"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- cells ---------------------------------------------------------------------------------------


@query(f"""WITH {_CELLS} SELECT dataset_id, strftime(min(time), '%Y-%m-%d') AS start, strftime(max(time), '%Y-%m-%d') AS "end", min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax
FROM cells WHERE time >= '1996-01-01' AND time < '1999-01-01' AND lon BETWEEN -13e0 AND -11e0 AND lat BETWEEN 8e0 AND 9.5e0 GROUP BY dataset_id""")
def subset_coverage(spark, sf_dir):
    return cells.coverage(cells.subset(fx.daily_cells(spark, sf_dir), "1996", "1998", (-13.0, 8.0, -11.0, 9.5)), F.lit("daily"))


@query(f"""WITH {_CELLS}, c AS (SELECT dataset_id, min(time) AS "start", max(time) AS "end", min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM cells GROUP BY 1)
SELECT t.dataset_id, c."start", c."end", xmin, ymin, xmax, ymax FROM (SELECT DISTINCT CASE WHEN o_custkey % 50 = 0 THEN 'grid_daily' ELSE 'ds_' || (o_custkey % 50) END AS dataset_id FROM orders WHERE o_custkey % 50 < 48) t LEFT JOIN c USING (dataset_id)""")
def template_coverage(spark, sf_dir):
    t = fx.templates(spark, sf_dir).select(F.when(F.col("dataset_id") == "ds_0", "grid_daily").otherwise(F.col("dataset_id")).alias("dataset_id"))
    return cells.with_coverage(t, cells.coverage(fx.daily_cells(spark, sf_dir)))


@query(f"""WITH {_CELLS} SELECT dataset_id, time, lon, lat, value FROM cells QUALIFY row_number() OVER (PARTITION BY time, ix, iy ORDER BY granule DESC, line DESC) = 1""")
def mosaic_newest_wins(spark, sf_dir):
    c = cells.mosaic(fx.daily_cells(spark, sf_dir), [F.desc("granule"), F.desc("line")], ["dataset_id", "time", "ix", "iy"])
    return c.select(*cells.KEY, "value")


@query(f"""WITH {_CELLS} SELECT (date_diff('day', DATE '1970-01-01', time::DATE) // 30)::BIGINT AS time_chunk, (ix // 8)::BIGINT AS tile_x, (iy // 8)::BIGINT AS tile_y, count(*) AS n, sum(value) AS total FROM cells GROUP BY ALL""")
def chunk_layout(spark, sf_dir):
    laid = cells.with_layout(fx.daily_cells(spark, sf_dir), "daily", F.col("ix"), F.col("iy"), spatial=8)
    return laid.groupBy("time_chunk", "tile_x", "tile_y").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_CELL_KEY = ["dataset_id", "time", "ix", "iy"]


def _newest() -> list:
    return [F.desc("granule"), F.desc("line")]


@query(f"""WITH {_CELLS}, k AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY time, ix, iy ORDER BY granule DESC, line DESC) = 1)
SELECT strftime(time, '%Y-%m') AS month, count(*) AS added, sum(value) AS total FROM k WHERE NOT EXISTS (SELECT 1 FROM cells s WHERE s.time = k.time AND s.ix = k.ix AND s.iy = k.iy AND s.granule % 2 = 0) GROUP BY 1""")
def incremental_append(spark, sf_dir):
    c = fx.daily_cells(spark, sf_dir)
    added = cells.append_missing(c.where("granule % 2 = 0"), c, _CELL_KEY, _newest())
    return added.groupBy(F.date_format("time", "yyyy-MM").alias("month")).agg(F.count("*").alias("added"), F.sum("value").alias("total"))


@query(f"""WITH {_CELLS}, k AS (SELECT * FROM cells WHERE time >= '1996-01-01' AND time < '{AS_OF}'::DATE + 1 AND lon BETWEEN -13e0 AND -11e0 AND lat BETWEEN 8e0 AND 9.5e0 QUALIFY row_number() OVER (PARTITION BY time, ix, iy ORDER BY granule DESC, line DESC) = 1)
SELECT strftime(time, '%Y-%m') AS month, count(*) AS added, sum(value) AS total FROM k WHERE NOT EXISTS (SELECT 1 FROM cells s WHERE s.time = k.time AND s.ix = k.ix AND s.iy = k.iy AND s.granule % 2 = 0) GROUP BY 1""")
def ingest_new(spark, sf_dir):
    c = fx.daily_cells(spark, sf_dir)
    new = cells.ingest(c, c.where("granule % 2 = 0"), "1996", None, (-13.0, 8.0, -11.0, 9.5), AS_OF, keys=_CELL_KEY, newest=_newest())
    return new.groupBy(F.date_format("time", "yyyy-MM").alias("month")).agg(F.count("*").alias("added"), F.sum("value").alias("total"))


@query(f"""WITH {_CELLS} SELECT strftime(time, '%Y-%m') AS month, count(*) AS added, sum(value) AS total FROM (SELECT * FROM cells WHERE time >= '1996-01-01' AND time < '1999-01-01' QUALIFY row_number() OVER (PARTITION BY time, ix, iy ORDER BY granule DESC, line DESC) = 1) GROUP BY 1""")
def ingest_overwrite(spark, sf_dir):
    c = fx.daily_cells(spark, sf_dir)
    new = cells.ingest(c, c, "1996", "1998", None, AS_OF, overwrite=True, keys=_CELL_KEY, newest=_newest())
    return new.groupBy(F.date_format("time", "yyyy-MM").alias("month")).agg(F.count("*").alias("added"), F.sum("value").alias("total"))


@query(f"""WITH {_CELLS} SELECT strftime(time, '%Y-%m') AS month, count(*) AS n, sum(value) AS total FROM cells WHERE time >= '1996-01-01' AND time < '2001-01-01' GROUP BY 1""")
def store_scan(spark, sf_dir):
    """Half of the cells go through a store, the newer half is read from granules."""
    c = cells.with_layout(fx.daily_cells(spark, sf_dir), "daily", F.col("ix"), F.col("iy"), spatial=8)
    with _folder(spark, "store") as path:
        cells.compact(c.where("time < '1999-01-01'").select(*cells.KEY, "value", "time_chunk", "tile_x", "tile_y"), path)
        both = cells.subset(cells.open_cells(spark, path, c, "grid_daily"), "1996", "2000")
        return cut(_monthly(both, "n"))


@query("""SELECT l_returnflag AS variable, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'F' GROUP BY 1""")
def granule_parameters(spark, sf_dir):
    g = fx.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS variable", "CASE l_linestatus WHEN 'F' THEN NULL ELSE 'prelim' END AS stage", "l_quantity AS value")
    return cells.by_parameters(g, ["A", "N"]).groupBy("variable").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


#: Order of ingestion: by granule, then line.
_INGESTED = "granule * 16 + line"
_BOX = "named_struct('xmin', -13e0, 'ymin', 8e0, 'xmax', -11.5e0, 'ymax', 9.5e0)"
_SYNCED = f"""synced AS (SELECT * FROM cells WHERE time >= '1999-01-01' AND time < '2000-07-01' QUALIFY row_number() OVER (PARTITION BY time, ix, iy ORDER BY granule DESC, line DESC) = 1)"""


@query(f"""WITH {_CELLS}, {_SYNCED}, k AS (SELECT 'grid_daily_west' AS managed_id, * FROM synced WHERE lon BETWEEN -13e0 AND -11.5e0 AND lat BETWEEN 8e0 AND 9.5e0 UNION ALL SELECT 'grid_daily_global', * FROM synced)
SELECT managed_id, strftime(time, '%Y-%m') AS month, count(*) AS added, sum(value) AS total FROM k GROUP BY 1, 2""")
def sync_apply(spark, sf_dir):
    """Two managed datasets of one template, one of them of a box."""
    c = fx.daily_cells(spark, sf_dir)
    stored = c.where("time < '1999-01-01'").withColumn("managed_id", F.explode(F.array(F.lit("grid_daily_west"), F.lit("grid_daily_global"))))
    end = stored.groupBy("dataset_id", "managed_id").agg(F.max("time").alias("created_at")).selectExpr("*", "'1998-12-31' AS coverage_end", "1 AS seq", f"CASE WHEN managed_id LIKE '%west' THEN {_BOX} END AS bbox")
    plan = sync.sync_plan(end, end.select("dataset_id", F.lit("daily").alias("period_type")).distinct(), "2000-06-30", AS_OF)
    new = sync.incremental(stored, c, plan, ["managed_id", *_CELL_KEY], _newest())
    return new.groupBy("managed_id", F.date_format("time", "yyyy-MM").alias("month")).agg(F.count("*").alias("added"), F.sum("value").alias("total"))


@query(f"""WITH {_CELLS}, {_SYNCED}, k AS (SELECT 'grid_daily_west' AS managed_id, * FROM synced WHERE lon BETWEEN -13e0 AND -11.5e0 AND lat BETWEEN 8e0 AND 9.5e0 UNION ALL SELECT 'grid_daily_global', * FROM synced)
SELECT managed_id, count(*) AS n, sum(value) AS total, strftime(max(time), '%Y-%m-%d') AS coverage_end, 'up_to_date' AS status FROM k GROUP BY 1""")
def sync_commit(spark, sf_dir):
    """Cells and records of a catch-up in one commit; a second one finds nothing due."""
    landed = fx.daily_cells(spark, sf_dir).withColumn("ingested", F.expr(_INGESTED))
    first = spark.range(2).selectExpr(
        "1L AS seq", "concat('a', id) AS artifact_id", "element_at(array('grid_daily_west', 'grid_daily_global'), cast(id AS int) + 1) AS managed_id", "'grid_daily' AS dataset_id", "cast(null AS string) AS extent_id",
        f"CASE WHEN id = 0 THEN {_BOX} END AS bbox", "'zarr' AS format", "timestamp '1999-01-01' AS created_at", "'1995' AS request_start", "'1998' AS request_end", "'1995-01-01' AS coverage_start", "'1998-12-31' AS coverage_end",
    )
    t = spark.sql("SELECT 'grid_daily' AS dataset_id, 'daily' AS period_type")
    with _folder(spark, "synced") as root:
        store.commit(spark, root, "first", records=first)
        sync.apply(spark, root, landed, t, "2000-06-30", AS_OF, "second")
        sync.apply(spark, root, landed, t, "2000-06-30", AS_OF, "second")
        got = store.newest(store.committed_cells(spark, root)).groupBy(F.col("dataset_id").alias("managed_id")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        records = catalog.latest(store.committed_records(spark, root))
        # Asked for no later end than what has landed.
        status = sync.sync_plan(records, t, "1999-01-01", AS_OF).select("managed_id", "coverage_end", "status")
        return cut(got.join(status, "managed_id"))


@query(f"""WITH {_CELLS}, req AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE 'grid_daily' END AS dataset_id, (1995 + c_custkey % 5)::VARCHAR AS s, CASE WHEN c_custkey % 2 = 0 THEN (1995 + c_custkey % 5) || '-06' END AS e,
  CASE WHEN c_custkey % 11 = 0 THEN 'nowhere' WHEN c_custkey % 3 = 1 THEN 'west' END AS extent_id FROM customer),
ok AS (SELECT min(request_id) AS request_id, s, e, extent_id FROM req WHERE dataset_id = 'grid_daily' AND coalesce(extent_id, '') <> 'nowhere' GROUP BY s, e, extent_id),
met AS (SELECT DISTINCT 'grid_daily_' || coalesce(extent_id, 'global') AS managed_id, time, ix, iy FROM ok JOIN cells ON time >= (s || '-01-01')::DATE AND time < CASE WHEN e IS NULL THEN DATE '{AS_OF}' + 1 ELSE (e || '-01')::DATE + INTERVAL 1 MONTH END
  AND (extent_id IS NULL OR (lon BETWEEN -13e0 AND -11.5e0 AND lat BETWEEN 8e0 AND 9.5e0))),
cov AS (SELECT managed_id, strftime(min(time), '%Y-%m-%d') AS coverage_start, strftime(max(time), '%Y-%m-%d') AS coverage_end, count(*) AS n FROM met GROUP BY 1)
SELECT request_id, managed_id, s AS request_start, e AS request_end, coverage_start, coverage_end, n, NULL::VARCHAR AS reason FROM ok JOIN cov ON managed_id = 'grid_daily_' || coalesce(extent_id, 'global')
UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, 0, CASE WHEN dataset_id = 'unknown' THEN 'unknown dataset' WHEN extent_id = 'nowhere' THEN 'unknown extent' WHEN request_id IN (SELECT request_id FROM ok) THEN 'no data' ELSE 'known' END
FROM req WHERE request_id NOT IN (SELECT request_id FROM ok JOIN cov ON managed_id = 'grid_daily_' || coalesce(extent_id, 'global'))""")
def ingestion_requests(spark, sf_dir):
    """A request of each customer: records and cells of the new ones, and reasons of the others."""
    r = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS request_id", "CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE 'grid_daily' END AS dataset_id", "cast(1995 + c_custkey % 5 AS string) AS start", "CASE WHEN c_custkey % 2 = 0 THEN concat(1995 + c_custkey % 5, '-06') END AS end",
        "CASE WHEN c_custkey % 11 = 0 THEN 'nowhere' WHEN c_custkey % 3 = 1 THEN 'west' END AS extent_id", "cast(null AS struct<xmin:double,ymin:double,xmax:double,ymax:double>) AS bbox", "false AS overwrite",
    )
    t = spark.sql("SELECT 'grid_daily' AS dataset_id, 'daily' AS period_type")
    e = spark.sql("SELECT 'west' AS id, array(-13e0, 8e0, -11.5e0, 9.5e0) AS bbox, 'X' AS country_code")
    landed = fx.daily_cells(spark, sf_dir).withColumn("ingested", F.expr(_INGESTED))
    with _folder(spark, "ingested") as root:
        lost = ingestion.create(spark, root, r, t, e, landed, AS_OF, "first")
        n = store.newest(store.committed_cells(spark, root)).groupBy(F.col("dataset_id").alias("managed_id")).agg(F.count("*").alias("n"))
        made = store.committed_records(spark, root).join(n, "managed_id")
        made = made.select(F.substring_index("artifact_id", "-", -1).cast("bigint").alias("request_id"), "managed_id", "request_start", "request_end", "coverage_start", "coverage_end", "n", F.lit(None).cast("string").alias("reason"))
        return cut(made.unionByName(lost.withColumn("n", F.lit(0).cast("bigint")), allowMissingColumns=True))


@query(f"""WITH {_CELLS}, k AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY time, ix, iy ORDER BY granule DESC, line DESC) = 1)
SELECT strftime(time, '%Y-%m') AS month, count(*) AS n, sum(value) AS total FROM k GROUP BY 1""")
def stream_store(spark, sf_dir):
    """Cells land as files in three parts, and a stream stores them in batches of some files; its values are those of all at once."""
    landed = fx.daily_cells(spark, sf_dir).withColumn("ingested", F.expr(_INGESTED))
    with _folder(spark, "stream") as root:
        for part in (1, 2, 0):  # the newest rows do not come last
            landed.where(f"granule % 3 = {part}").select(schemas.LANDED.names).write.mode("append").parquet(f"{root}/landing")
            stream_sync(spark, f"{root}/landing", f"{root}/store", f"{root}/state", files_per_batch=64).awaitTermination()
        return cut(_monthly(store.newest(store.committed_cells(spark, f"{root}/store")), "n"))


@query(f"""WITH {_CELLS} SELECT dataset_id, time, lon, lat, CASE WHEN value <> 50 THEN value END AS value FROM cells""")
def nodata_filter(spark, sf_dir):
    return cells.without_nodata(fx.daily_cells(spark, sf_dir).select(*cells.KEY, "value"), 50.0)


@query(f"""WITH {_CELLS} SELECT time, lat, lon FROM cells WHERE time >= '1996-06-01' AND time < '1996-07-01' AND lon BETWEEN -13e0 AND -12e0 AND lat BETWEEN 8e0 AND 9e0 ORDER BY time, lat, lon LIMIT 20""")
def preview(spark, sf_dir):
    return cells.preview(cells.subset(fx.daily_cells(spark, sf_dir), "1996-06", "1996-06", (-13.0, 8.0, -12.0, 9.0))).select("time", "lat", "lon")


@query(f"""WITH {_CELLS} SELECT count(DISTINCT granule) AS file_count, strftime(min(time), '%Y-%m-%d') AS start, strftime(max(time), '%Y-%m-%d') AS "end", 'completed' AS status, count(DISTINCT granule) || ' files' AS message FROM cells""")
def run_summary(spark, sf_dir):
    return export.run_summary(fx.daily_cells(spark, sf_dir), "granule")


# --- periods and identity ------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {_TYPE} AS period_type, {_PERIOD.format(t='o_orderdate', p=_TYPE)} AS period FROM orders")
def period_strings(spark, sf_dir):
    return fx.artifacts(spark, sf_dir).select(F.col("seq").alias("o_orderkey"), F.col("own_type").alias("period_type"), F.col("coverage_end").alias("period"))


@query(f"""SELECT o_orderkey, CASE {_TYPE} WHEN 'hourly' THEN strftime(date_trunc('hour', o_orderdate) + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') WHEN 'daily' THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d')
WHEN 'monthly' THEN strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m') ELSE strftime(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR, '%Y') END AS next_start FROM orders""")
def next_period_start(spark, sf_dir):
    return fx.artifacts(spark, sf_dir).select(F.col("seq").alias("o_orderkey"), periods.next_period_start(F.col("coverage_end"), F.col("own_type")).alias("next_start"))


@query(f"""WITH p AS (SELECT o_orderkey, o_orderdate AS t, {_TYPE} AS k FROM orders) SELECT o_orderkey, date_trunc(CASE k WHEN 'hourly' THEN 'hour' WHEN 'daily' THEN 'day' WHEN 'monthly' THEN 'month' ELSE 'year' END, t)::TIMESTAMP AS lower,
CASE k WHEN 'hourly' THEN date_trunc('hour', t) + INTERVAL 1 HOUR WHEN 'daily' THEN date_trunc('day', t) + INTERVAL 1 DAY WHEN 'monthly' THEN date_trunc('month', t) + INTERVAL 1 MONTH ELSE date_trunc('year', t) + INTERVAL 1 YEAR END::TIMESTAMP AS upper FROM p""")
def period_bounds(spark, sf_dir):
    p = F.col("coverage_end")
    return fx.artifacts(spark, sf_dir).select(F.col("seq").alias("o_orderkey"), periods.lower_bound(p).alias("lower"), periods.upper_bound(p).alias("upper"))


@query(f"WITH {_ARTIFACTS} SELECT seq, managed_id FROM artifacts")
def managed_id(spark, sf_dir):
    return _managed(spark, sf_dir).select("seq", "managed_id")


@query(f"WITH b AS (SELECT DISTINCT {_BOX_TEXT} AS bbox FROM orders WHERE o_orderpriority LIKE '3%') SELECT bbox, {_adler('bbox')} AS hash FROM b")
def bbox_hash(spark, sf_dir):
    b = fx.artifacts(spark, sf_dir).where("bbox is not null").select(identity.bbox_text(F.col("bbox")).alias("bbox")).distinct()
    return b.select("bbox", identity.adler32(F.col("bbox")).alias("hash"))


@query("""SELECT o_orderkey, (o_custkey % 4) - 13.5e0 AS xmin, CASE WHEN o_orderkey % 3 = 0 THEN 6.9e0 END AS ymin, o_orderkey % 3 = 0 AS whole FROM (SELECT * FROM orders) WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, NULL, NULL, false FROM orders WHERE o_orderkey % 3 <> 0""")
def bbox_parse(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    text = F.expr("concat(' ', (o_custkey % 4) - 13.5e0, ' ,6.9,', CASE o_orderkey % 3 WHEN 0 THEN '1, 2' WHEN 1 THEN '1' ELSE '1,north' END)")
    box = identity.parsed_bbox(text)
    return o.select("o_orderkey", box["xmin"].alias("xmin"), box["ymin"].alias("ymin"), box.isNotNull().alias("whole"))


# --- catalog -------------------------------------------------------------------------------------


@query(f"""WITH {_ARTIFACTS} SELECT managed_id AS dataset_id, dataset_id AS source_dataset_id, 'Dataset ' || k AS dataset_name, 'v' AS variable, coalesce(period_type, 'unknown') AS period_type, CASE WHEN period_type IS NOT NULL THEN 'Short ' || k END AS short_name,
  NULL::VARCHAR AS units, '1995-01-01' AS "start", coverage_end AS "end", CASE WHEN box IS NOT NULL THEN box - 13.5e0 END AS xmin, created_at AS last_updated, CASE WHEN is_published THEN 'published' ELSE 'unpublished' END AS status FROM latest""")
def catalog_list(spark, sf_dir):
    d = catalog.datasets(fx.artifacts(spark, sf_dir), fx.templates(spark, sf_dir))
    return d.select("dataset_id", "source_dataset_id", "dataset_name", "variable", "period_type", "short_name", "units", "extent.temporal.start", "extent.temporal.end", "extent.spatial.xmin", "last_updated", "publication.status")


@query(f"""WITH {_ARTIFACTS} SELECT managed_id, row_number() OVER (PARTITION BY managed_id ORDER BY created_at DESC, seq)::BIGINT AS version_no, seq, format, coverage_end FROM artifacts""")
def version_history(spark, sf_dir):
    return catalog.version_history(_managed(spark, sf_dir)).select("managed_id", "version_no", "seq", "format", "coverage_end")


@query(f"""WITH {_ARTIFACTS}, v AS (SELECT managed_id, seq, format, created_at, (row_number() OVER (PARTITION BY managed_id ORDER BY created_at DESC, seq) - 1) // 20 AS page FROM artifacts)
SELECT managed_id, page::BIGINT AS page, string_agg(seq || ':' || format, ',' ORDER BY created_at DESC, seq) AS versions, count(*) AS n FROM v GROUP BY 1, 2""")
def dataset_details(spark, sf_dir):
    d = catalog.dataset_details(_managed(spark, sf_dir).withColumn("id", F.col("seq")), ["id", "format"])
    return d.select("managed_id", "page", F.array_join(F.transform("versions", lambda v: F.concat_ws(":", v["id"], v["format"])), ",").alias("versions"), F.size("versions").cast("bigint").alias("n"))


@query(f"""WITH {_ARTIFACTS}, newest AS (SELECT dataset_id, extent_id, box, max(seq) AS seq FROM base WHERE format = 'zarr' GROUP BY ALL)
SELECT r.seq AS request_id, a.seq FROM base r JOIN newest a ON a.dataset_id = r.dataset_id AND a.extent_id IS NOT DISTINCT FROM r.extent_id AND a.box IS NOT DISTINCT FROM r.box""")
def dedup_lookup(spark, sf_dir):
    a = fx.artifacts(spark, sf_dir).select("seq", "dataset_id", "extent_id", "bbox", "format")
    return catalog.dedup_lookup(a, a.withColumnRenamed("seq", "request_id"), ["extent_id", "bbox"], prefer_zarr=True)


@query(f"""WITH {_ARTIFACTS}, stored AS (SELECT DISTINCT dataset_id, extent_id, box FROM base WHERE format = 'netcdf' AND created_at < '1995-03-01')
SELECT r.seq FROM base r WHERE NOT EXISTS (SELECT 1 FROM stored a WHERE a.dataset_id = r.dataset_id AND a.extent_id IS NOT DISTINCT FROM r.extent_id AND a.box IS NOT DISTINCT FROM r.box)""")
def new_requests(spark, sf_dir):
    a = fx.artifacts(spark, sf_dir).select("seq", "dataset_id", "extent_id", "bbox", "format", "created_at")
    return catalog.new_requests(a.where("format = 'netcdf' and created_at < '1995-03-01'"), a.drop("created_at"), ["extent_id", "bbox"]).select("seq")


@query(f"""WITH {_ARTIFACTS} SELECT a.seq::VARCHAR AS artifact_id, l.managed_id, l.seq, l.coverage_end FROM artifacts a JOIN latest l USING (managed_id)""")
def ingestion_dataset(spark, sf_dir):
    a = _managed(spark, sf_dir)
    return catalog.datasets_of(a, a).select("artifact_id", "managed_id", "seq", "coverage_end")


@query(f"""WITH {_ARTIFACTS} SELECT seq, CASE WHEN is_published THEN 'replaced' ELSE format END AS format, CASE WHEN is_published THEN 2 ELSE 1 END AS version_seq FROM base""")
def record_versions(spark, sf_dir):
    """Records are stored, the published ones replaced, and the versions that count read back."""
    with _folder(spark, "records") as path:
        first = fx.artifacts(spark, sf_dir).select("artifact_id", "seq", "format", "is_published", F.lit(1).alias("version_seq"))
        catalog.append_records(first, path)
        stored = spark.read.parquet(path)
        catalog.append_records(catalog.replacing(stored, stored.where("is_published").withColumn("format", F.lit("replaced"))), path)
        return cut(catalog.current_versions(spark.read.parquet(path)).select("seq", "format", "version_seq"))


@query(f"""WITH {_ARTIFACTS} SELECT seq, 'published' AS status, CASE WHEN is_published THEN NULL ELSE managed_id END AS collection_id FROM artifacts""")
def publication_update(spark, sf_dir):
    a = _managed(spark, sf_dir)
    changes = catalog.published(a.where("not is_published"), F.lit(AS_OF)).select("artifact_id", "publication")
    return catalog.updated_publications(a, changes).select("seq", "publication.status", "publication.collection_id")


@query(f"""WITH {_ARTIFACTS}, p AS (SELECT * FROM artifacts WHERE is_published QUALIFY row_number() OVER (PARTITION BY managed_id ORDER BY seq DESC) = 1)
SELECT managed_id AS id, 'Dataset ' || k AS title, dataset_id || ',v' AS keywords, CASE WHEN box IS NOT NULL THEN box - 13.5e0 END AS xmin, '1995-01-01' AS begin, coverage_end AS "end", format FROM p""")
def collection_metadata(spark, sf_dir):
    c = catalog.collection_metadata(catalog.published_collections(_managed(spark, sf_dir))).select("collection.*")
    return c.select("id", "title", F.array_join("keywords", ",").alias("keywords"), F.col("extents.spatial.bbox")[0].alias("xmin"), "extents.temporal.begin", "extents.temporal.end", "format")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 THEN -13.5e0 ELSE 0e0 END AS xmin FROM customer WHERE c_nationkey <> 7""")
def spatial_arguments(spark, sf_dir):
    r = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN named_struct('xmin', cast(c_acctbal AS double), 'ymin', 0e0, 'xmax', 1e0, 'ymax', 1e0) END AS bbox",
        "CASE WHEN c_nationkey <> 7 THEN concat('X', c_nationkey) END AS country_code",
    )
    own = catalog.spatial_arguments(r.where("c_custkey % 3 <> 2"), default_bbox="-13.5, 6.9, -10.1, 10")[0]
    rest = catalog.spatial_arguments(r.where("c_custkey % 3 = 2"), bounds=(0, 0, 1, 1))[0]
    return own.unionByName(rest).select("c_custkey", "bbox.xmin")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal::DOUBLE END AS xmin, CASE WHEN c_custkey % 3 <> 0 THEN 'invalid bbox' END AS reason FROM customer""")
def extent_validation(spark, sf_dir):
    e = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_name AS description",
        "CASE c_custkey % 3 WHEN 0 THEN array(cast(c_acctbal AS string), '1', '2', '3') WHEN 1 THEN array('1', '2', '3') ELSE array('1', '2', '3', 'north') END AS bbox",
    )
    ok, lost = catalog.valid_extents(e)
    none = lambda t: F.lit(None).cast(t)
    return ok.select("id", F.col("bbox")[0].alias("xmin"), none("string").alias("reason")).union(lost.select("id", none("double"), "reason"))


@query(f"""WITH {_ARTIFACTS} SELECT seq, '1995-01-01' AS start, coverage_end AS "end", CASE WHEN box IS NOT NULL THEN box - 13.5e0 END AS xmin FROM base""")
def legacy_scope(spark, sf_dir):
    old = fx.artifacts(spark, sf_dir).withColumn("request_scope", F.lit(None).cast(schemas.REQUEST_SCOPE))
    return catalog.upgraded(old).select("seq", "request_scope.start", "request_scope.end", "request_scope.bbox.xmin")


@query(f"""WITH {_ARTIFACTS} SELECT managed_id, max(seq) AS seq FROM artifacts WHERE is_published GROUP BY 1""")
def published_collections(spark, sf_dir):
    return catalog.published_collections(_managed(spark, sf_dir)).select("managed_id", "seq")


@query(f"""WITH {_ARTIFACTS} SELECT seq, 'published' AS status, CASE WHEN NOT is_published THEN managed_id END AS collection_id, CASE WHEN NOT is_published THEN '/ogcapi/collections/' || managed_id END AS path FROM artifacts""")
def publish(spark, sf_dir):
    p = catalog.published(_managed(spark, sf_dir), F.lit(AS_OF))
    return p.select("seq", "publication.status", "publication.collection_id", "publication.path")


@query(f"""WITH {_ARTIFACTS} SELECT managed_id, seq FROM latest ORDER BY managed_id LIMIT 20 OFFSET 20""")
def catalog_page(spark, sf_dir):
    return catalog.page(catalog.latest(fx.artifacts(spark, sf_dir)).select("managed_id", "seq"), "managed_id", offset=20)


@query("""WITH t AS (SELECT DISTINCT o_custkey % 50 AS k FROM orders) SELECT 'ds_' || k AS id, CASE WHEN k % 3 = 0 THEN 'second' ELSE 'first' END AS origin, k AS position FROM t WHERE k < 48""")
def template_union(spark, sf_dir):
    t = fx.templates(spark, sf_dir).select(F.col("dataset_id").alias("id"), "position")
    return catalog.template_union([t.withColumn("origin", F.lit("first")), t.where("position % 3 = 0").withColumn("origin", F.lit("second"))])


@query("""SELECT 'ext_' || (o_custkey % 20) AS id, min(o_orderkey) AS position FROM orders GROUP BY 1""")
def extent_first(spark, sf_dir):
    e = fx.table(spark, sf_dir, "orders").selectExpr("concat('ext_', o_custkey % 20) AS id", "o_orderkey AS position")
    return catalog.first_extents(e)


@query(f"""WITH {_ARTIFACTS} SELECT seq, CASE WHEN k >= 48 THEN 'unknown dataset' WHEN extent_id = 'ext_b' THEN 'unknown extent' END AS reason FROM base""")
def request_resolution(spark, sf_dir):
    r = fx.artifacts(spark, sf_dir).select("seq", "dataset_id", "extent_id")
    e = fx.artifacts(spark, sf_dir).where("extent_id = 'ext_a'").select(F.col("extent_id").alias("id")).distinct().selectExpr("id", "array(0e0, 0e0, 1e0, 1e0) AS bbox", "'X' AS country_code")
    found, lost = catalog.matched_requests(r, fx.templates(spark, sf_dir), e)
    return found.select("seq", F.lit(None).cast("string").alias("reason")).unionByName(lost.select("seq", "reason"))


@query(f"""WITH {_ARTIFACTS} SELECT managed_id, CASE WHEN period_type IS NULL THEN 'unknown' WHEN n > '{AS_OF}' THEN 'up_to_date' ELSE 'due' END AS status, CASE WHEN n <= '{AS_OF}' THEN n END AS start, CASE WHEN n <= '{AS_OF}' THEN '{AS_OF}' END AS "end", extent_id
FROM (SELECT *, CASE period_type WHEN 'hourly' THEN strftime(date_trunc('hour', created_at) + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') WHEN 'daily' THEN strftime(created_at + INTERVAL 1 DAY, '%Y-%m-%d')
WHEN 'monthly' THEN strftime(date_trunc('month', created_at) + INTERVAL 1 MONTH, '%Y-%m') WHEN 'yearly' THEN strftime(date_trunc('year', created_at) + INTERVAL 1 YEAR, '%Y') END AS n FROM latest)""")
def sync_plan(spark, sf_dir):
    return sync.sync_plan(fx.artifacts(spark, sf_dir), fx.templates(spark, sf_dir), None, AS_OF).select("managed_id", "status", "start", "end", "extent_id")


# --- series --------------------------------------------------------------------------------------


@query(f"WITH {_HOURLY} SELECT time, lon, round(value, 6) AS value FROM hourly")
def deaccumulate(spark, sf_dir):
    from pyspark.sql import Window

    h = fx.hourly_cells(spark, sf_dir)
    w = Window.partitionBy("lon", F.to_date(F.col("time") - F.expr("interval 1 hour"))).orderBy("time")
    return _rounded(series.deaccumulate(h.withColumn("value", F.sum("value").over(w))).select("time", "lon", "value"), "value")


@query(f"""WITH {_HOURLY}, d AS (SELECT lon, time::DATE AS day, sum(value) AS value FROM hourly GROUP BY ALL), i AS (SELECT lon, day - (row_number() OVER (PARTITION BY lon ORDER BY day))::INTEGER AS island FROM d WHERE value > 50)
SELECT lon, max(n) AS longest_spell FROM (SELECT lon, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1""")
def spell_length(spark, sf_dir):
    daily = series.resample(fx.hourly_cells_in_order(spark, sf_dir), "daily", order=["seq"])
    return series.spell_length(daily, 50.0).select("lon", "longest_spell")


def _resample(resolution: str, unit: str) -> None:
    def run(spark, sf_dir):
        return _rounded(series.resample(fx.hourly_cells(spark, sf_dir), resolution).select("lon", "time", "value"), "value")

    run.__name__ = f"resample_{resolution}"
    query(f"WITH {_HOURLY} SELECT lon, date_trunc('{unit}', time)::TIMESTAMP AS time, round(sum(value), 6) AS value FROM hourly GROUP BY ALL")(run)


for _r, _u in (("daily", "day"), ("weekly", "week"), ("monthly", "month")):
    _resample(_r, _u)


@query(f"WITH {_HOURLY} SELECT time, lon, round(value - 273.15e0, 6) AS celsius, round(value * 1000e0, 6) AS mm FROM hourly")
def unit_convert(spark, sf_dir):
    h = fx.hourly_cells(spark, sf_dir)
    c = series.convert_units(h, "kelvin", "degC").withColumnRenamed("value", "celsius").withColumn("value", F.col("celsius") + 273.15)
    return _rounded(series.convert_units(c, "m", "mm").select("time", "lon", "celsius", F.col("value").alias("mm")), "celsius", "mm")


@query(f"WITH {_HOURLY} SELECT time, lon, round(CASE lon::BIGINT % 3 WHEN 0 THEN value - 273.15e0 WHEN 1 THEN value * 1000e0 ELSE value END, 6) AS value FROM hourly")
def unit_convert_by_row(spark, sf_dir):
    h = fx.hourly_cells(spark, sf_dir).selectExpr("time", "lon", "value", "element_at(array('kelvin', 'm', 'mm'), cast(lon % 3 AS int) + 1) AS units", "element_at(array('degC', 'mm', 'mm'), cast(lon % 3 AS int) + 1) AS convert_units")
    return _rounded(series.convert_by_row(h, series.conversions(spark)).select("time", "lon", "value"), "value")


@query(f"""WITH {_HOURLY} SELECT lon, time::DATE::TIMESTAMP AS time, round(sum(value) * 1000e0, 6) AS value FROM hourly GROUP BY ALL""")
def template_steps(spark, sf_dir):
    steps = series.template_steps({"pre_process": ["resample_daily"], "units": "m", "convert_units": "mm"})
    return _rounded(series.processed(fx.hourly_cells(spark, sf_dir), steps).select("lon", "time", "value"), "value")


# --- zones ---------------------------------------------------------------------------------------


@query(f"""WITH {_CELLS}, {_ZONES}, {_INSIDE} SELECT zone_id, count(value) AS count, sum(value) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM zones LEFT JOIN inside USING (zone_id) LEFT JOIN cells USING (lon, lat) GROUP BY 1""")
def zonal_stats(spark, sf_dir):
    return _rounded(zones.zonal_statistics(fx.daily_cells(spark, sf_dir), fx.nation_zones(spark, sf_dir), ("count", "sum", "mean", "min", "max")), "mean")


@query(f"""WITH {_CELLS}, {_ZONES}, {_INSIDE} SELECT zone_id, median(value) AS median, round(stddev_pop(value), 6) AS std FROM zones LEFT JOIN inside USING (zone_id) LEFT JOIN cells USING (lon, lat) GROUP BY 1""")
def zonal_median_std(spark, sf_dir):
    return _rounded(zones.zonal_statistics(fx.daily_cells(spark, sf_dir), fx.nation_zones(spark, sf_dir), ("median", "std")), "std")


@query(f"""WITH {_CELLS}, {_ZONES}, {_INSIDE}, touched AS (SELECT zone_id, lon, lat FROM positions, edges WHERE least(x1, x2) <= lon + 4e-2 AND greatest(x1, x2) >= lon - 4e-2 AND least(y1, y2) <= lat + 4e-2 AND greatest(y1, y2) >= lat - 4e-2
UNION SELECT zone_id, lon, lat FROM inside)
SELECT zone_id, count(value) AS count, sum(value) AS sum FROM zones LEFT JOIN touched USING (zone_id) LEFT JOIN cells USING (lon, lat) GROUP BY 1""")
def zonal_all_touched(spark, sf_dir):
    return zones.zonal_statistics(fx.daily_cells(spark, sf_dir), fx.nation_zones(spark, sf_dir), ("count", "sum"), all_touched=(0.08, 0.08))


@query(f"""WITH {_CELLS} SELECT s_suppkey AS point_id, time, value FROM supplier JOIN cells ON cells.ix = s_suppkey % 68 AND cells.iy = s_suppkey % 62""")
def point_values(spark, sf_dir):
    return zones.point_values(fx.daily_cells(spark, sf_dir), fx.points(spark, sf_dir), fx.LON0, fx.LAT0, fx.STEP, -fx.STEP).select("point_id", "time", "value")


_UNIT_SQL = f"""WITH {_CELLS}, {_ZONES}, {_INSIDE}, daily AS (SELECT zone_id, time, avg(value) AS v FROM cells JOIN inside USING (lon, lat) GROUP BY ALL)"""
_UNITS = """units AS (SELECT 'N' || n_nationkey AS zone_id, n_name AS name, 'R' || n_regionkey AS parent_id, 3 AS level FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name, 'ROOT', 2 FROM region
UNION ALL SELECT 'ROOT', 'World', NULL, 1 UNION ALL SELECT 'C' || c_custkey, c_name, 'N' || c_nationkey, 4 FROM customer)"""


@query(f"""WITH RECURSIVE {_UNITS}, t AS (SELECT * FROM units WHERE zone_id = 'R1' UNION ALL SELECT u.* FROM units u JOIN t ON u.parent_id = t.zone_id) SELECT zone_id, level, parent_id FROM t""")
def unit_subtree(spark, sf_dir):
    return zones.subtree(fx.units(spark, sf_dir), "R1").select("zone_id", "level", "parent_id")


@query(f"""WITH {_UNITS} SELECT zone_id FROM units WHERE level BETWEEN 3 AND 4 AND (name ILIKE '%a%7%' OR parent_id IN ('R1', 'N2')) AND NOT name LIKE 'U%'""")
def attribute_filter(spark, sf_dir):
    return zones.attribute_filter(fx.units(spark, sf_dir), "level BETWEEN 3 AND 4 AND (name ILIKE '%a%7%' OR parent_id IN ('R1', 'N2')) AND NOT name LIKE 'U%' AND name IS NOT NULL").select("zone_id")


@query(f"""WITH {_UNITS} SELECT name, level FROM units""")
def field_projection(spark, sf_dir):
    return zones.fields(fx.units(spark, sf_dir), ["name", "level"])


@query(f"""WITH {_UNITS} SELECT zone_id FROM units WHERE parent_id = 'N3' AND level = 4 UNION ALL SELECT zone_id FROM units WHERE zone_id IN ('R1', 'N2')
UNION ALL SELECT zone_id FROM units WHERE level = 4 AND zone_id IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def unit_selection(spark, sf_dir):
    u = fx.units(spark, sf_dir)
    asked = fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("concat('C', o_custkey) AS zone_id")
    chosen = zones.select_zones(u, level=4, parent="N3").union(zones.select_zones(u, ids=["R1", "N2"])).union(zones.select_zones(u, level=4, ids=asked))
    return chosen.select("zone_id")


@query("""SELECT CASE WHEN c_custkey % 2 = 0 THEN 'F' || c_custkey ELSE c_name END AS zone_id FROM customer""")
def feature_ids(spark, sf_dir):
    f = fx.table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 2 = 0 THEN concat('F', c_custkey) END AS id", "map('code', c_name) AS properties")
    return zones.feature_ids(f, "code").select("zone_id")


_SHAPES = "corners(r, i, m, a, b) AS (VALUES " + ", ".join(f"({r}, {i}, {len(ring)}, {a}, {b})" for r, ring in enumerate(fx.SHAPE) for i, (a, b) in enumerate(ring)) + """),
fields AS (SELECT 'S' || n_nationkey AS zone_id, -13.525e0 + (n_nationkey % 5) * 7e-1 AS x0, 10.025e0 - (n_nationkey // 5) * 6e-1 AS y0 FROM nation),
edges AS (SELECT zone_id, x0 + p.a AS x1, y0 - p.b AS y1, x0 + q.a AS x2, y0 - q.b AS y2 FROM fields, corners p JOIN corners q ON q.r = p.r AND q.i = (p.i + 1) % p.m)"""


@query(f"""WITH {_CELLS}, {_SHAPES}, {_INSIDE} SELECT zone_id, count(value) AS count, sum(value) AS sum, median(value) AS median FROM fields LEFT JOIN inside USING (zone_id) LEFT JOIN cells USING (lon, lat) GROUP BY 1""")
def zonal_shapes(spark, sf_dir):
    """Slanted sides, a hole and a second part."""
    return zones.zonal_statistics(fx.daily_cells(spark, sf_dir), fx.shapes(spark, sf_dir), ("count", "sum", "median"))


@query(f"""WITH {_CELLS}, {_SHAPES}, {_INSIDE}, touched AS (SELECT zone_id, lon, lat FROM positions, edges WHERE least(x1, x2) <= lon + 4e-2 AND greatest(x1, x2) >= lon - 4e-2 AND least(y1, y2) <= lat + 4e-2 AND greatest(y1, y2) >= lat - 4e-2
  AND abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) <= abs(x2 - x1) * 4e-2 + abs(y2 - y1) * 4e-2 UNION SELECT zone_id, lon, lat FROM inside)
SELECT zone_id, count(value) AS count, sum(value) AS sum FROM fields LEFT JOIN touched USING (zone_id) LEFT JOIN cells USING (lon, lat) GROUP BY 1""")
def zonal_shapes_touched(spark, sf_dir):
    """Every cell that a slanted side, a hole's side or another part's side reaches, too."""
    return zones.zonal_statistics(fx.daily_cells(spark, sf_dir), fx.shapes(spark, sf_dir), ("count", "sum"), all_touched=(0.08, 0.08))


@query(f"""{_UNIT_SQL.replace('avg(value) AS v', 'median(value) AS v')} SELECT zone_id, date_trunc('week', time)::TIMESTAMP AS period, max(v) AS value FROM daily GROUP BY ALL""")
def unit_week_medians(spark, sf_dir):
    return zones.unit_values(fx.daily_cells(spark, sf_dir), fx.nation_zones(spark, sf_dir), "weekly", "median", "max")


def _geojson(shapes: DataFrame) -> DataFrame:
    """``zone_id`` and ``f``, a feature: the second ring is a hole of the first one, the third a part of its own."""
    closed = F.transform("rings", lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"])))
    parts = F.array(F.array(closed[0], closed[1]), F.array(closed[2]))
    return shapes.select("zone_id", F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("code"), F.col("zone_id")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")).alias("geometry")).alias("f"))


@query(f"""WITH {_CELLS}, {_SHAPES}, {_INSIDE} SELECT zone_id, count(value) AS count, sum(value) AS sum, round(avg(value), 6) AS mean FROM fields LEFT JOIN inside USING (zone_id) LEFT JOIN cells USING (lon, lat) GROUP BY 1""")
def geojson_zones(spark, sf_dir):
    """Multipolygons with holes, written as collections of features and read back, with the cells of each."""
    shape = _geojson(fx.shapes(spark, sf_dir))
    files = shape.groupBy((F.crc32("zone_id") % 4).alias("file")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))).alias("value"))
    with _folder(spark, "features") as root:
        files.repartition("file").write.partitionBy("file").text(root)
        z = cut(readers.features(spark, root, "code").select("zone_id", "rings"))
    return _rounded(zones.zonal_statistics(fx.daily_cells(spark, sf_dir), z, ("count", "sum", "mean")), "mean")


@query(f"""WITH {_CELLS}, {_SHAPES}, {_INSIDE}, v AS (SELECT lon, lat, CASE WHEN value <> 50 THEN value END AS value FROM cells)
SELECT zone_id AS id, zone_id AS code, 'MultiPolygon' AS kind, count(value) AS count, sum(value) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, median(value) AS median FROM fields LEFT JOIN inside USING (zone_id) LEFT JOIN v USING (lon, lat) GROUP BY 1""")
def zonal_process(spark, sf_dir):
    """Features from files of GeoJSON lines, and features out again, with statistics under a property of the caller's name; 50 stands for no data."""
    stats = ("count", "sum", "mean", "min", "max", "median")
    with _folder(spark, "features") as root:
        _geojson(fx.shapes(spark, sf_dir)).select(F.to_json("f").alias("value")).write.text(root)
        features = cut(readers.features(spark, root, "code", lines=True))
    out = processes.zonal_process(features, fx.daily_cells(spark, sf_dir), stats, "population_stats", nodata=50.0)
    kind = "struct<id:string,properties:struct<code:string,population_stats:struct<count:bigint,sum:double,mean:double,min:double,max:double,median:double>>,geometry:struct<type:string>>"
    f = out.select(F.from_json("feature", kind).alias("f"))
    return _rounded(f.select("f.id", "f.properties.code", F.col("f.geometry.type").alias("kind"), "f.properties.population_stats.*"), "mean")


@query(f"""WITH {_ZONES} SELECT 'R' || n_regionkey AS parent_id, round(min(x1), 6) AS xmin, round(min(e.y1), 6) AS ymin, round(max(x1), 6) AS xmax, round(max(e.y1), 6) AS ymax FROM edges e JOIN nation ON zone_id = 'N' || n_nationkey GROUP BY 1""")
def total_bounds(spark, sf_dir):
    return _rounded(zones.bounds(fx.nation_zones(spark, sf_dir), "parent_id"), "xmin", "ymin", "xmax", "ymax")


@query(f"{_UNIT_SQL} SELECT zone_id, date_trunc('month', time)::TIMESTAMP AS period, round(sum(v), 6) AS value FROM daily GROUP BY ALL")
def unit_month_values(spark, sf_dir):
    return _rounded(zones.unit_values(fx.daily_cells(spark, sf_dir), fx.nation_zones(spark, sf_dir)), "value")


@query(f"""{_UNIT_SQL}, w AS (SELECT zone_id, isoyear(time) || 'W' || week(time) AS period, max(v) AS value FROM daily GROUP BY ALL) SELECT period, zone_id, round(value, 6) AS value FROM w""")
def data_values(spark, sf_dir):
    v = export.data_values(zones.unit_values(fx.daily_cells(spark, sf_dir), fx.nation_zones(spark, sf_dir), "weekly", temporal="max"), "PRECIP", "weekly")
    d = F.from_json("data_value", "struct<period:string,orgUnit:string,value:double>")
    return v.select(d["period"].alias("period"), d["orgUnit"].alias("zone_id"), F.round(d["value"], 6).alias("value"))


@query(f"""{_UNIT_SQL}, m AS (SELECT zone_id, strftime(time, '%Y%m') AS period, sum(v) AS value FROM daily JOIN nation ON zone_id = 'N' || n_nationkey WHERE n_regionkey = 1 AND time >= '1996-02-01' AND time < '1999-01-01' GROUP BY ALL)
SELECT 'RAIN' AS element, period, zone_id, round(value, 6) AS value, 'C' AS category FROM m""")
def aggregation_process(spark, sf_dir):
    """Data values of the units of one level below one parent, over three years."""
    out = processes.aggregation_process(fx.zones(spark, sf_dir), fx.daily_cells(spark, sf_dir), "1996-02", "1998", "RAIN", level=3, parent="R1", category="C")
    d = F.from_json("data_value", "struct<dataElement:string,period:string,orgUnit:string,value:double,categoryOptionCombo:string>")
    return out.select(d["dataElement"].alias("element"), d["period"].alias("period"), d["orgUnit"].alias("zone_id"), F.round(d["value"], 6).alias("value"), d["categoryOptionCombo"].alias("category"))


@query("""SELECT 'station_' || (user_id % 3) AS dataset_id, count(*) AS n FROM events GROUP BY 1""")
def station_counts(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").selectExpr("concat('station_', user_id % 3) AS dataset_id", "ts AS valid_time", "1e0 AS longitude", "2e0 AS latitude", "value AS v")
    return cells.one_variable(e, "v").groupBy("dataset_id").agg(F.count("*").alias("n"))


# --- sources -------------------------------------------------------------------------------------


@query(f"""WITH {_CELLS}, g AS (SELECT *, CASE WHEN granule % 3 = 0 THEN 'a_modified' ELSE 'a' END AS id, strftime(time, '%Y') AS y FROM cells), h AS (SELECT lon, lat, min(y) AS y0 FROM g WHERE id = 'a' GROUP BY ALL)
SELECT 'a_' || g.y AS granule, count(*) AS n, sum(value) AS total, count(*) FILTER (g.y::INT % 2 = 0) AS flagged, sum(y0::BIGINT)::BIGINT AS height FROM g JOIN h USING (lon, lat) WHERE id = 'a' GROUP BY ALL""")
def granule_scan(spark, sf_dir):
    """Granules of two datasets whose ids begin alike; those of even years have one more column, and all a static one that the first one decides."""
    c = fx.daily_cells(spark, sf_dir).withColumns({"year": F.year("time"), "id": F.when(F.col("granule") % 3 == 0, "a_modified").otherwise("a")})
    c = c.select(F.concat_ws("_", "id", "year").alias("granule"), "time", "lon", "lat", "value", F.col("year").cast("bigint").alias("height"), F.lit(1).alias("flag"), "year")
    with _folder(spark, "granules") as root:
        c.where("year % 2 = 1").drop("flag", "year").write.partitionBy("granule").parquet(root)
        c.where("year % 2 = 0").drop("year").write.mode("append").partitionBy("granule").parquet(root)
        g = readers.granules(spark, root, "a", static=("height",))
        return cut(g.groupBy("granule").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count("flag").alias("flagged"), F.sum("height").alias("height")))


@query("""SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 't' || p_partkey END AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'daily' END AS period_type, CASE WHEN p_partkey % 7 = 0 THEN '{"id": "t' || p_partkey || '", broken' END AS bad FROM part""")
def template_source(spark, sf_dir):
    """Templates as lines of JSON, some of them broken."""
    p = fx.table(spark, sf_dir, "part")
    whole = F.to_json(F.struct(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 5 == 0, "daily").alias("period_type")))
    line = F.when(F.col("p_partkey") % 7 == 0, F.format_string('{"id": "t%d", broken', F.col("p_partkey"))).otherwise(whole)
    with _folder(spark, "templates") as root:
        p.select(line.alias("value")).write.text(root)
        good, bad = readers.templates(spark, root)
        none = F.lit(None).cast("string")
        return cut(good.select("id", "period_type", none.alias("bad")).union(bad.select(none, none, F.col("value"))))


@query("""SELECT CASE WHEN c_custkey % 6 > 1 THEN 'e' || c_custkey END AS id, CASE WHEN c_custkey % 6 > 1 THEN c_acctbal::DOUBLE END AS xmin, CASE WHEN c_custkey % 6 = 1 THEN '{"name":"' || c_name || '"}' WHEN c_custkey % 6 = 0 THEN '[broken' END AS bad FROM customer""")
def extent_source(spark, sf_dir):
    """Extents as lines of JSON: some without an id, some broken."""
    c = fx.table(spark, sf_dir, "customer")
    whole = F.to_json(F.struct(F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.col("c_acctbal").cast("double"), F.lit(0e0), F.lit(1e0), F.lit(2e0)).alias("bbox")))
    line = F.when(F.col("c_custkey") % 6 == 0, "[broken").when(F.col("c_custkey") % 6 == 1, F.to_json(F.struct(F.col("c_name").alias("name")))).otherwise(whole)
    with _folder(spark, "extents") as root:
        c.select(line.alias("value")).write.text(root)
        good, bad = readers.extents(spark, root)
        return cut(good.select("id", F.col("bbox")[0].alias("xmin"), F.lit(None).cast("string").alias("bad")).union(bad.select(F.lit(None).cast("string"), F.lit(None).cast("double"), "value")))


@query("""SELECT 'station_' || (user_id % 30) AS dataset_id, date_trunc('second', ts)::TIMESTAMP AS time, (user_id % 30)::DOUBLE - 75e0 AS lon, 45e0 AS lat, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL""")
def station_source(spark, sf_dir):
    """Observations of stations as CSV files, read as cells."""
    e = fx.table(spark, sf_dir, "events").selectExpr("cast(0 AS bigint) AS id", "user_id % 30 AS stn_id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS datetime", "value", "45e0 AS lat", "cast(user_id % 30 AS double) - 75e0 AS long")
    with _folder(spark, "stations") as root:
        e.write.option("header", True).csv(root)
        s = readers.stations(spark, root)
        return cut(_rounded(s.groupBy("dataset_id", "time", "lon", "lat").agg(F.count("*").alias("n"), F.sum("value").alias("value")), "value"))


@query(f"""WITH {_CELLS} SELECT strftime(time, '%Y-%m') AS month, count(*) AS n, sum(value) AS total FROM cells WHERE time >= '1996-01-01' AND time < '1998-01-01' AND lon BETWEEN -13e0 AND -11e0 AND lat BETWEEN 8e0 AND 9.5e0 GROUP BY 1""")
def subset_export(spark, sf_dir):
    """A subset written as one file, and read back."""
    part = cells.subset(fx.daily_cells(spark, sf_dir), "1996", "1997", (-13.0, 8.0, -11.0, 9.5)).select(*cells.KEY, "value")
    with _folder(spark, "export") as root:
        export.write_subset(part, root, "csv", one_file=True)
        back = spark.read.schema(schemas.CELLS).option("header", True).csv(root)
        return cut(_monthly(back, "n"))


@query(f"""WITH {_CELLS} SELECT strftime(time, '%Y-%m') AS month, count(*) AS n, sum(value) AS total FROM cells WHERE time >= '1996-01-01' AND time < '1997-01-01' GROUP BY 1""")
def partial_bbox(spark, sf_dir):
    """A box that lacks a bound selects nothing less than all."""
    return _monthly(cells.subset(fx.daily_cells(spark, sf_dir), "1996", "1996", (-13.0, 8.0, None, 9.5)), "n")


@query(f"""WITH {_CELLS} SELECT 'daily' AS loader, strftime(time, '%Y-%m') AS month, count(*) AS n, sum(value) AS total FROM cells WHERE time >= '1996-01-01' AND time < '1997-01-01' GROUP BY 2
UNION ALL SELECT 'hourly', strftime(ts, '%Y-%m'), count(*), round(sum(value), 6) FROM events GROUP BY 2""")
def loader_options(spark, sf_dir):
    """Loaders by name, each called with those of the same parameters that it takes."""
    known = readers.Loaders()
    known.add("daily", lambda s, path, start, end: cells.subset(fx.daily_cells(s, path), start, end))
    known.add("hourly", lambda s, path: fx.table(s, path, "events").select(F.col("ts").alias("time"), "value"))
    made = [_monthly(known.load(n, spark, path=sf_dir, start="1996", end="1996", bbox=None, country_code="X"), "n").select(F.lit(n).alias("loader"), "*") for n in ("daily", "hourly")]
    return made[0].union(_rounded(made[1], "total"))
