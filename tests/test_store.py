"""Commits: cells and records appear at once or not at all, and streams end like batches."""

import pytest
from pyspark.sql import functions as F

from terracell import fixtures as fx
from terracell import schemas
from terracell.operators import cells, store
from terracell.plans import ingestion, sync
from terracell.streaming.sync import stream_sync

SF = "/root/testdata/sf0.001"


def landed_rows(spark):
    return fx.daily_cells(spark, SF).withColumn("ingested", F.expr("granule * 16 + line"))


def grid(spark, rows):
    df = spark.createDataFrame(rows, "dataset_id string, time string, lon double, lat double, value double, ingested bigint")
    return df.withColumn("time", F.col("time").cast("timestamp_ntz"))


def first_record(spark, managed=("ds_sle",), end="2026-01-31", boxes=(None,)):
    rows = [(1, m, m, "ds", "sle", b, "zarr", "2026", "2026", "2026-01-01", end) for m, b in zip(managed, boxes)]
    kinds = "seq bigint, artifact_id string, managed_id string, dataset_id string, extent_id string, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, format string, request_start string, request_end string, coverage_start string, coverage_end string"
    return spark.createDataFrame(rows, kinds).withColumn("created_at", F.lit("2026-02-01").cast("timestamp"))


@pytest.fixture
def templates(spark):
    return spark.createDataFrame([("ds", "daily")], "dataset_id string, period_type string")


def feb(spark, days=range(1, 11), lon=0.0):
    return grid(spark, [("ds", f"2026-02-{d:02d}", lon, 0.0, float(d), 10 * d) for d in days])


def state(spark, root):
    rows = store.newest(store.committed_cells(spark, root)).select("dataset_id", F.date_format("time", "MM-dd").alias("d"), "value").collect()
    records = store.committed_records(spark, root).select("managed_id", "seq", "coverage_end").collect()
    return sorted(map(tuple, rows)), sorted(map(tuple, records))


def test_a_catch_up_appears_at_once(spark, tmp_path, templates, monkeypatch):
    root = str(tmp_path / "store")
    assert state(spark, root) == ([], [])
    assert store.commit(spark, root, "first", records=first_record(spark))
    before = state(spark, root)
    assert before == ([], [("ds_sle", 1, "2026-01-31")])

    run = lambda: sync.apply(spark, root, feb(spark), templates, "2026-02-05", "2026-02-07", "second")
    # Killed after the cells are written, before the records are, and again before the manifest is.
    real = store._read
    for nth in (1, 2):
        left = [nth]

        def killed(spark, path, schema):
            if path.endswith(("/cells", "/records")) and (tmp_path / "store/cells/commit=second").exists():
                left[0] -= 1
                if not left[0]:
                    raise KeyboardInterrupt
            return real(spark, path, schema)

        monkeypatch.setattr(store, "_read", killed)
        with pytest.raises(KeyboardInterrupt):
            run()
        monkeypatch.setattr(store, "_read", real)
        assert (tmp_path / "store/cells/commit=second").exists() and state(spark, root) == before
    assert run() is True
    after = state(spark, root)
    assert [d for _, d, _ in after[0]] == [f"02-{d:02d}" for d in range(1, 6)] and after[1] == [("ds_sle", 1, "2026-01-31"), ("ds_sle", 2, "2026-02-05")]
    assert run() is False and state(spark, root) == after
    # The next one takes up where this one ended; nothing that has not landed makes a record.
    assert sync.apply(spark, root, feb(spark), templates, "2026-02-10", "2026-02-10", "third")
    assert len(state(spark, root)[0]) == 10
    assert sync.apply(spark, root, feb(spark), templates, "2026-03-10", "2026-03-10", "fourth") and len(state(spark, root)[1]) == 3
    plan = sync.sync_plan(store.committed_records(spark, root), templates, "2026-02-10", "2030").first()
    assert plan["status"] == "up_to_date" and plan["extent_id"] == "sle"


def test_box_of_the_latest_record_holds(spark, tmp_path, templates):
    root = str(tmp_path / "store")
    store.commit(spark, root, "first", records=first_record(spark, ("west", "all"), boxes=((-1.0, -1.0, 0.5, 1.0), None)))
    landed = feb(spark).unionByName(feb(spark, lon=1.0))
    sync.apply(spark, root, landed, templates, "2026-02-05", "2026-02-07", "second")
    n = {r["dataset_id"]: r["count"] for r in store.committed_cells(spark, root).groupBy("dataset_id").count().collect()}
    assert n == {"west": 5, "all": 10}
    # Records carry the box on.
    assert {r["managed_id"]: r["bbox"] and r["bbox"]["xmax"] for r in store.committed_records(spark, root).where("seq = 2").collect()} == {"west": 0.5, "all": None}


def test_requests_from_end_to_end(spark, tmp_path, templates):
    """Equal, unknown, overwriting and empty requests; a second batch finds what the first one stored."""
    root = str(tmp_path / "store")
    kinds = "request_id bigint, dataset_id string, start string, end string, extent_id string, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, overwrite boolean"
    box = (-1.0, -1.0, 0.5, 1.0)
    first = [
        (1, "ds", "2026-02-01", "2026-02-03", "sle", None, False), (2, "ds", "2026-02-01", "2026-02-03", "sle", None, False), (3, "ds", "2026-02", None, None, box, False), (4, "no", "2026", None, None, None, False),
        (5, "ds", "2026", None, "mars", None, False), (6, "ds", "2030", "2031", "far", None, False), (7, "ds", "2026-02-02", "2026-02-04", "sle", None, False), (8, "ds", "2026-02-08", "2026-02-08", "sle", None, False),
    ]
    extents = spark.createDataFrame([("sle", [0.5, -1.0, 2.0, 1.0], "SLE"), ("far", [50.0, 50.0, 51.0, 51.0], "FAR")], "id string, bbox array<double>, country_code string")
    landed = feb(spark).unionByName(feb(spark, lon=1.0))
    run = lambda rows, name: sorted(map(tuple, ingestion.create(spark, root, spark.createDataFrame(rows, kinds), templates, extents, landed, "2026-02-07", name).select("request_id", "reason").collect()))
    assert run(first, "one") == [(2, "known"), (4, "unknown dataset"), (5, "unknown extent"), (6, "no data")]
    records = lambda: {r["artifact_id"]: (r["seq"], r["coverage_start"], r["coverage_end"]) for r in store.committed_records(spark, root).collect()}
    assert records() == {"one-1": (1, "2026-02-01", "2026-02-08"), "one-3": (2, "2026-02-01", "2026-02-07"), "one-7": (3, "2026-02-01", "2026-02-08"), "one-8": (4, "2026-02-01", "2026-02-08")}
    days = lambda: sorted((r["dataset_id"], r["lon"], r["time"].day) for r in store.committed_cells(spark, root).collect())
    own = next(r["dataset_id"] for r in store.committed_cells(spark, root).where("dataset_id like '%bbox%'").collect())
    expect = [(own, 0.0, d) for d in range(1, 8)] + [("ds_sle", 1.0, d) for d in (1, 2, 3, 4, 8)]
    assert days() == expect
    # The same again is known; overwriting makes a record and no cell; another window adds what is missing.
    again = [(1, *first[0][1:]), (9, *first[0][1:-1], True), (10, "ds", "2026-02-04", "2026-02-06", "sle", None, False)]
    assert run(again, "two") == [(1, "known")]
    assert records()["two-9"] == (5, "2026-02-01", "2026-02-08") and records()["two-10"] == (6, "2026-02-01", "2026-02-08")
    assert days() == sorted(expect + [("ds_sle", 1.0, d) for d in (5, 6)])


def test_windows_prune_landed_folders(spark, tmp_path, templates):
    from terracell.functions import periods

    path = str(tmp_path / "landing")
    landed_rows(spark).withColumn("dataset_id", F.lit("ds")).withColumn("time_chunk", periods.time_chunk(F.col("time"), "daily")).write.partitionBy("dataset_id", "time_chunk").parquet(path)
    landed = spark.read.parquet(path)
    plan = sync.sync_plan(first_record(spark, end="1998-12-31"), templates, "1999-03-31", "2030")
    got = sync.due_cells(landed, plan)
    expect = landed_rows(spark).where("time >= '1999-01-01' and time < '1999-04-01'")
    assert got.count() == expect.count() and got.select("managed_id").distinct().first()[0] == "ds_sle"
    assert "dynamicpruning" in got._jdf.queryExecution().optimizedPlan().toString()


def test_additions(spark):
    stored = grid(spark, [("d", "2024-01-01", 0.0, 0.0, 1.0, None), ("d", "2024-01-02", 0.0, 0.0, 1.0, 5), ("d", "2024-01-03", 0.0, 0.0, 1.0, 5), ("d", "2024-01-03", 0.0, 0.0, 4.0, 9)])
    stored = stored.withColumn("time_chunk", F.expr("cast(floor(datediff(time, date '1970-01-01') / 30) as bigint)"))
    landed = grid(spark, [("d", f"2024-01-0{k}", 0.0, 0.0, float(v), i) for k, v, i in ((1, 7, 99), (2, 5, 6), (2, 2, 7), (2, 9, 3), (3, 8, 9), (4, 5, None), (4, 6, None), (5, 1, 1))])
    assert sorted((r["time"].day, r["value"]) for r in store.additions(stored, landed).collect()) == [(2, 2.0), (4, 6.0), (5, 1.0)]
    assert store.additions(stored, landed.limit(0)).count() == 0 and store.additions(stored.limit(0), landed).count() == 5


@pytest.mark.parametrize("files", [None, 1])
def test_stream_equals_batch(spark, tmp_path, files):
    """Value for value what one batch adds, whatever the order and number of landings; a replay adds nothing."""
    root, landing, state_ = (str(tmp_path / n) for n in ("store", "landing", "state"))
    rows = landed_rows(spark)
    for part in (2, 0, 1):
        rows.where(f"granule % 3 = {part}").select(schemas.LANDED.names).coalesce(2).write.mode("append").parquet(landing)
        for _ in range(2):
            stream_sync(spark, landing, root, state_, files_per_batch=files).awaitTermination()
    t = spark.createDataFrame([("grid_daily", "daily")], "dataset_id string, period_type string")
    plan = sync.sync_plan(first_record(spark, ("grid_daily",), "1900-01-01").withColumn("dataset_id", F.lit("grid_daily")), t, "2100-01-01", "2100-01-01")
    batch = sync.incremental(rows.limit(0), rows, plan, cells.KEY, [F.desc("ingested")]).select(*cells.KEY, "value")
    got = store.newest(store.committed_cells(spark, root)).select(*cells.KEY, "value")
    assert got.exceptAll(batch).isEmpty() and got.count() == batch.count()

    # The same files under a state that knows nothing of them: all has been stored.
    n = store.committed_cells(spark, root).count()
    stream_sync(spark, landing, root, str(tmp_path / "other")).awaitTermination()
    assert store.committed_cells(spark, root).count() == n


def test_older_file_with_a_larger_value_gives_way(spark, tmp_path):
    """Rows without an order of ingestion are ordered by when their files were written."""
    root, landing = str(tmp_path / "store"), str(tmp_path / "landing")
    for value in (5.0, 2.0):
        grid(spark, [("d", "2024-01-01", 0.0, 0.0, value, None)]).coalesce(1).write.mode("append").parquet(landing)
    stream_sync(spark, landing, root, str(tmp_path / "state")).awaitTermination()
    assert [r["value"] for r in store.newest(store.committed_cells(spark, root)).collect()] == [2.0]


def test_a_batch_is_resolved_once(spark, tmp_path, monkeypatch):
    """A landing is resolved once for what it adds, and a commit is given rows that are kept, as its ranges read them twice."""
    stored = grid(spark, [("d", "2024-01-02", 0.0, 0.0, 1.0, 5)]).withColumn("time_chunk", F.lit(0).cast("bigint"))
    new = store.additions(stored, grid(spark, [("d", "2024-01-01", 0.0, 0.0, 1.0, 1)]))
    assert new._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    given, real = [], store.commit

    def commit(spark, root, name, cells, **more):
        given.append(cells._jdf.queryExecution().optimizedPlan().toString())
        return real(spark, root, name, cells, **more)

    monkeypatch.setattr(store, "commit", commit)
    landing = str(tmp_path / "landing")
    feb(spark).coalesce(1).write.parquet(landing)
    stream_sync(spark, landing, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    assert len(given) == 1 and "Window" not in given[0] and "LogicalRDD" in given[0]
    assert store.committed_cells(spark, str(tmp_path / "store")).count() == 10
