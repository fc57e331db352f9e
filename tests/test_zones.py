"""The cover of zones against a plain ray test of every cell and zone, and the distributed median against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell import fixtures as fx
from terracell.operators import zones

SF = "/root/testdata/sf0.001"
ZONES = "zone_id string, rings array<array<struct<x:double,y:double>>>"


def star(x, y, r, n, rng, rough=0.4):
    """A simple polygon of n vertices around a centre."""
    return [(x + r * (1 - rough * rng.random()) * math.cos(2 * math.pi * k / n), y + r * (1 - rough * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def inside(rings, lon, lat):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def frame(spark, shapes):
    return spark.createDataFrame([(k, [[{"x": a, "y": b} for a, b in ring] for ring in rings]) for k, rings in shapes.items()], ZONES)


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(4)
    square = [(-3.0, -3.0), (3.0, -3.0), (3.0, 3.0), (-3.0, 3.0)]  # sides on cell centres and on sides of tiles
    return {
        "star": [star(10.0, 5.0, 6.0, 400, rng)], "hole": [star(-20.0, -10.0, 8.0, 60, rng, 0.1), star(-20.0, -10.0, 3.0, 30, rng)],
        "parts": [star(30.0, 30.0, 1.0, 9, rng), star(33.0, 30.0, 1.5, 14, rng), star(31.0, 34.0, 0.05, 5, rng)], "square": [square],
        "large": [[(-60.0, -40.0), (70.0, -41.5), (75.0, 45.0), (-58.0, 44.0)]], "thin": [[(0.01, 20.0), (15.0, 20.003), (0.0, 20.01)]], "tiles": [[(0.0, 0.0), (25.6, 0.0), (25.6, 25.6), (0.0, 25.6)]],
    }


def test_cover_against_every_pair(spark, shapes):
    rng = random.Random(8)
    at = [(rng.uniform(-70, 80), rng.uniform(-45, 50)) for _ in range(300)] + [(x / 2, y / 2) for x in range(-8, 9) for y in range(-8, 9)]
    at += [(10 + rng.gauss(0, 4), 5 + rng.gauss(0, 4)) for _ in range(400)] + [(-20 + rng.gauss(0, 5), -10 + rng.gauss(0, 5)) for _ in range(400)] + [(31 + rng.gauss(0, 2), 31 + rng.gauss(0, 2)) for _ in range(300)]
    at += [(rng.uniform(0, 15), rng.uniform(19.99, 20.02)) for _ in range(200)] + [(25.6 * k / 16, 25.6 * j / 64) for k in range(17) for j in (0, 1, 63, 64)]
    at = list(dict.fromkeys(at))
    p = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(at)], "lon double, lat double, tile int")
    got = {(r["tile"], r["zone_id"]) for r in zones.cells_in_zones(p, frame(spark, shapes)).collect()}
    assert got == {(i, k) for i, (a, b) in enumerate(at) for k, rings in shapes.items() if inside(rings, a, b)}


def meets(ring, x0, y0, x1, y1):
    """Whether a ring's border meets a box: an end inside, or a side of the box crossed."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    box = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    for p, q in zip(ring, ring[1:] + ring[:1]):
        if any(x0 <= c[0] <= x1 and y0 <= c[1] <= y1 for c in (p, q)):
            return True
        if any(turn(p, q, a) * turn(p, q, b) <= 0 and turn(a, b, p) * turn(a, b, q) <= 0 for a, b in zip(box, box[1:] + box[:1])):
            return True
    return False


def test_all_touched_against_every_pair(spark, shapes):
    rng = random.Random(9)
    at = [(10 + rng.gauss(0, 5), 5 + rng.gauss(0, 5)) for _ in range(300)] + [(31 + rng.gauss(0, 3), 31 + rng.gauss(0, 3)) for _ in range(200)] + [(rng.uniform(-1, 16), rng.uniform(19.5, 20.5)) for _ in range(100)]
    p = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(at)], "lon double, lat double, i int")
    got = {(r["i"], r["zone_id"]) for r in zones.cells_in_zones(p, frame(spark, shapes), (0.5, 0.3)).collect()}
    near = lambda rings, a, b: inside(rings, a, b) or any(meets(r, a - 0.25, b - 0.15, a + 0.25, b + 0.15) for r in rings)
    assert got == {(i, k) for i, (a, b) in enumerate(at) for k, rings in shapes.items() if near(rings, a, b)}


def test_rows_follow_the_border(spark):
    """Cells inside meet no edge; tiles grow with the vertices, and hardly with the area."""
    rng = random.Random(1)
    cover = lambda n, r: zones.cover(frame(spark, {"z": [star(0.3, 0.2, r, n, rng, 0.02)]})).select(F.size("tile.edges").alias("n"), "tile.level").collect()
    few, many, wide = cover(1_000, 20.0), cover(10_000, 20.0), cover(1_000, 80.0)
    assert sum(t["n"] == 0 for t in few) > 20  # tiles inside
    assert all(t["n"] <= zones.FEW_EDGES or t["level"] == zones.LEVELS - 1 for t in few + many + wide)
    # Sides of this shape are long beside its tiles, so several tiles have one.
    assert sum(t["n"] for t in many) < 8 * 10_000 and sum(t["n"] for t in few) < 8 * 1_000
    assert len(many) < 20 * len(few) and len(wide) < 3 * len(few)


def test_a_zone_of_many_vertices(spark):
    rng = random.Random(3)
    shape = [star(1.0, 1.0, 9.0, 100_000, rng, 0.0001)]
    tiles = zones.cover(frame(spark, {"z": shape})).agg(F.count("*").alias("n"), F.sum(F.size("tile.edges")).alias("e")).first()
    assert tiles["e"] < 4 * 100_000 and tiles["n"] < 100_000
    at = [(1 + 9 * (0.99 + 0.015 * rng.random()) * math.cos(a), 1 + 9 * (0.99 + 0.015 * rng.random()) * math.sin(a)) for a in (rng.uniform(0, 6.28) for _ in range(40))]
    p = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(at)], "lon double, lat double, i int")
    assert {r["i"] for r in zones.cells_in_zones(p, frame(spark, {"z": shape})).collect()} == {i for i, (a, b) in enumerate(at) if inside(shape, a, b)}


@pytest.mark.parametrize("buckets", [4096, 3])
def test_median(spark, monkeypatch, buckets):
    monkeypatch.setattr(zones, "BUCKETS", buckets)
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(0, 1, 3001), "even": rng.normal(5, 100, 4000), "same": np.full(50, 2.5), "one": np.array([7.0]), "two": np.array([1.0, 4.0]), "outlier": np.r_[rng.normal(0, 1e-6, 2000), 1e300, -1e300],
        "ties": rng.integers(0, 4, 1000).astype(float), "split": np.r_[np.zeros(500), np.ones(500)], None: rng.random(99),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "zone_id string, value double")
    got = {r["zone_id"]: r["median"] for r in zones._median(df, ["zone_id"]).collect()}
    assert got == pytest.approx({k: float(np.median(v)) for k, v in groups.items()}, rel=1e-12)
    assert zones._median(df.limit(0), ["zone_id"]).count() == 0


def test_statistics_by_key(spark):
    c = fx.daily_cells(spark, SF).withColumn("year", F.year("time"))
    z = fx.nation_zones(spark, SF)
    got = zones.zonal_statistics(c, z, zones.REDUCERS, keys=("year",))
    where = zones.cells_in_zones(c.select("lon", "lat").distinct(), z)
    made = {"count": F.count("value"), "sum": F.sum("value"), "mean": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "median": F.median("value"), "std": F.stddev_pop("value")}
    expect = c.join(where, ["lon", "lat"]).groupBy("zone_id", "year").agg(*(made[r].alias(r) for r in zones.REDUCERS))
    text = lambda df: sorted((r["zone_id"], r["year"], *(round(r[k], 6) for k in zones.REDUCERS)) for r in df.collect())
    assert text(got) == text(expect) and got.count() > 20
    # One join of positions and zones, whatever is asked for.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 0
