"""Places and running values against windows."""

import pytest
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from terracell.operators import ranks


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows under one key, a third one repeated row, nulls, and names that clash."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "same").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"),
        F.when(F.col("id") % 3 == 1, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 7919 % 997).alias("at"), F.lit(1).alias("_at"), F.lit(2).alias("_part"),
    )
    return df.withColumn("key", F.when(F.col("key") == "k5", None).otherwise(F.col("key")))


@pytest.mark.parametrize("keys", [["key"], []])
def test_places(rows, keys):
    got = ranks.placed(rows, keys, [F.desc_nulls_last("at")], "n")
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("at"))
    expect = rows.withColumn("n", F.row_number().over(w).cast("bigint"))
    assert got.columns == expect.columns
    got, expect = got.select(*keys, "at", "n"), expect.select(*keys, "at", "n")
    assert got.exceptAll(expect).isEmpty() and got.count() == expect.count()


def test_running(rows):
    got = ranks.running(rows, ["key"], [F.asc("at")], {"s": (F.sum, Column.__add__, "at"), "x": (F.bit_xor, Column.bitwiseXOR, "at")})
    # Rows that are equal in the order are in either order: the last of them has the value of all.
    last = got.groupBy("key", "at").agg(F.max("s").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy(F.asc("at")).rangeBetween(Window.unboundedPreceding, 0)
    expect = rows.withColumn("s", F.sum("at").over(w)).groupBy("key", "at").agg(F.max("s").alias("s"), F.count("*").alias("n"))
    assert last.exceptAll(expect).isEmpty() and last.count() == expect.count()
    distinct = rows.where("at is not null").dropDuplicates(["key", "at"])
    x = ranks.running(distinct, ["key"], [F.asc("at")], {"x": (F.bit_xor, Column.bitwiseXOR, "at")})
    y = distinct.withColumn("x", F.bit_xor("at").over(Window.partitionBy("key").orderBy("at")))
    assert x.exceptAll(y).isEmpty() and x.count() == y.count()


def test_no_range_holds_a_hot_key(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as small as the ranges are
    try:
        made = ranks._ranges(rows, ["key"], [F.asc("at")], "a", "t").groupBy(F.floor(F.col("a") / (1 << 33)).alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made) >= 6 and max(r["count"] for r in made) < 2 * 6000 / len(made)


def test_empty(rows):
    assert ranks.placed(rows.limit(0), ["key"], [F.asc("at")]).count() == 0
