"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from terracell import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def normal(df):
    df = df[sorted(df.columns)]
    text = lambda v: "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else v.isoformat()[:19] if hasattr(v, "isoformat") else str(v)
    return sorted(tuple(text(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    expect = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expect.columns)
    assert normal(got) == normal(expect)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())


def test_spells_at_the_threshold(spark, tmp_path):
    """Floats that add up to 50 or to more, depending on how they are grouped: the SQL takes them as they come."""
    values = ((3.64, 1.49), (23.09, 21.78))
    assert ((3.64 + 1.49) + 23.09) + 21.78 <= 50 < (3.64 + 1.49) + (23.09 + 21.78)
    for k, part in enumerate(values):  # a file each, so that a task adds up each part
        rows = [(2 * k + i, v) for i, v in enumerate(part)] + [(100 + 2 * k, 60.0)] * k
        df = spark.createDataFrame(rows, "event_id bigint, value double").selectExpr("event_id", "timestamp_ntz '2024-01-01 07:00:00' AS ts", "if(value = 60, 8L, 7L) AS user_id", "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["spell_length"](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id")
    assert normal(got) == normal(c.execute(registry.oracle_sql()["spell_length"]).df())
    assert got["lon"].tolist() == [8.0]
