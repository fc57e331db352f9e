"""Zones: which cells lie in which polygon, and statistics of each zone.

Each zone is covered by the tiles of a quadtree. A tile that many edges of the zone reach is cut into
smaller ones, so that tiles are small along a border and large inside; tiles outside are left out, and
those inside have no edges. Cells meet tiles by an equi-join, level by level, and only those in a tile
with edges take the ray test, against that tile's few edges. So no pair of cell and zone is made that
shares no tile, and a zone makes rows in proportion to its border, not to its area.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods
from ..shared import cut
from . import ranks

#: Side of the largest tiles in degrees, into how many a side is cut at each level, and the levels.
LARGEST, CUT, LEVELS = 12.8, 8, 4
#: Edges of a tile that is not cut any more.
FEW_EDGES = 12
#: Slack in degrees when an edge is held against a tile.
SLACK = 1e-9
#: Rows of a small table that may be sent to all executors, once they are counted.
BROADCAST_ROWS = 200_000
#: Buckets into which a zone's values fall when its median is looked for.
BUCKETS = 4096
REDUCERS = ("count", "sum", "mean", "min", "max", "median", "std")
#: Names that a text filter may use.
FILTER_COLUMNS = ("name", "code", "shortname", "level", "openingdate", "zone_id", "parent_id")


def with_edges(zones: DataFrame) -> DataFrame:
    """``edges``: the sides of each zone's closed rings.

    A ray that crosses an odd count of them starts inside, so holes and zones of several parts need
    nothing else.
    """
    side = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    after = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return zones.withColumn("edges", F.flatten(F.transform(_rings(zones), lambda r: F.zip_with(r, after(r), side))))


def _rings(zones: DataFrame) -> Column:
    """All rings of a zone: ``rings`` (outer ones and holes of all parts), or else the one in ``ring``."""
    return F.col("rings") if "rings" in zones.columns else F.array("ring")


def bounds(zones: DataFrame, *keys: str) -> DataFrame:
    """Bounding box of all vertices, of each key if keys are given."""
    v = zones.select(*keys, F.explode(F.flatten(_rings(zones))).alias("p"))
    return v.groupBy(*keys).agg(F.min("p.x").alias("xmin"), F.min("p.y").alias("ymin"), F.max("p.x").alias("xmax"), F.max("p.y").alias("ymax"))


def _side(level: int) -> float:
    return LARGEST / CUT**level


def _crosses(e: str, lon: str, lat: str) -> str:
    """SQL: whether a ray from a point to the east crosses an edge; half-open, so borders belong to one zone."""
    at = f"({e}.x2 - {e}.x1) * ({lat} - {e}.y1) / nullif({e}.y2 - {e}.y1, 0D) + {e}.x1"
    return f"coalesce((({e}.y1 > {lat}) != ({e}.y2 > {lat})) and {lon} < {at}, false)"


def _meets(e: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """SQL: whether an edge meets a box: their bounds overlap, and the part of it between the box's sides reaches its height."""
    over = f"least({e}.x1, {e}.x2) <= {x1} and greatest({e}.x1, {e}.x2) >= {x0} and least({e}.y1, {e}.y2) <= {y1} and greatest({e}.y1, {e}.y2) >= {y0}"

    def part(f: str, axis: str, lo: str, hi: str, none: str) -> str:
        run = f"nullif({e}.{axis}2 - {e}.{axis}1, 0D)"
        return f"coalesce({f}(({lo} - {e}.{axis}1) / {run}, ({hi} - {e}.{axis}1) / {run}), {none})"

    first = f"greatest(0D, {part('least', 'x', x0, x1, '0D')}, {part('least', 'y', y0, y1, '0D')})"
    last = f"least(1D, {part('greatest', 'x', x0, x1, '1D')}, {part('greatest', 'y', y0, y1, '1D')})"
    return f"({over} and {first} <= {last})"


def _odd(edges: str, test: str) -> str:
    return f"(size(filter({edges}, e -> {test})) % 2 = 1)"


def _inside(t: str, lon: str, lat: str) -> str:
    """SQL: whether a point of a tile is inside: as the tile's centre is, unless an odd count of changes lies between.

    An edge that is not the tile's passes it on one side at all heights. Those to the east change how
    often a ray to the east is crossed, from the centre's height to the point's, where they end; they
    end where an edge of the tile begins, as rings are closed. So the tile's own edges tell it all.
    """
    side = f"element_at(array({', '.join(f'{_side(k)!r}D' for k in range(LEVELS))}), {t}.level + 1)"
    x, y = f"(({t}.tx + 0.5D) * {side})", f"(({t}.ty + 0.5D) * {side})"
    passed = lambda k: f"(e.x{k} >= ({t}.tx + 1) * {side} and (e.y{k} > {lat}) != (e.y{k} > {y}))"
    change = f"((({_crosses('e', lon, lat)}) != ({_crosses('e', x, y)})) != {passed(1)}) != {passed(2)}"
    return f"if(size({t}.edges) = 0, {t}.inside, {t}.inside != {_odd(f'{t}.edges', change)})"


def cover(zones: DataFrame, margin: float = 0.0) -> DataFrame:
    """``zone_id`` and ``tile``: level, tx, ty, whether the centre is inside, and the edges within ``margin`` of the tile.

    Tiles outside, with no edge near, are left out.
    """
    wide = f"{margin + SLACK!r}D"

    def near(edges: str, tx: str, ty: str, side: float, across: int = 1) -> str:
        """The edges that meet a tile, or a band of tiles side by side."""
        box = (f"({tx}) * {side!r}D - {wide}", f"({ty}) * {side!r}D - {wide}", f"({tx} + {across}) * {side!r}D + {wide}", f"({ty} + 1) * {side!r}D + {wide}")
        return f"filter({edges}, e -> {_meets('e', *box)})"

    def tile(level: int, tx: str, ty: str, inside: str, edges: str, band: bool = False) -> str:
        return f"named_struct('level', {level}, 'tx', cast({tx} AS bigint), 'ty', cast({ty} AS bigint), 'inside', {inside}, 'edges', {edges}, 'band', {str(band).lower()})"

    x_of = y_of = lambda t, side: f"(({t} + 0.5D) * {side!r}D)"
    z = with_edges(zones).selectExpr("zone_id", "coalesce(edges, cast(array() AS array<struct<x1:double,y1:double,x2:double,y2:double>>)) AS edges").where("size(edges) > 0")
    whole = _side(0)
    for n, c in (("ty", "y"), ("tx", "x")):
        ends = f"transform(edges, e -> least(e.{c}1, e.{c}2))", f"transform(edges, e -> greatest(e.{c}1, e.{c}2))"
        z = z.withColumn(n, F.expr(f"explode(sequence(floor((array_min({ends[0]}) - {wide}) / {whole!r}D), floor((array_max({ends[1]}) + {wide}) / {whole!r}D)))"))
    first = tile(0, "tx", "ty", _odd("edges", _crosses("e", x_of("tx", whole), y_of("ty", whole))), near("edges", "tx", "ty", whole))
    z = z.selectExpr("zone_id", f"{first} AS tile")
    kept = "size(tile.edges) > 0 or tile.inside"
    parts = f"sequence(0, {CUT - 1})"
    for level in range(1, LEVELS):
        side = _side(level)
        # A tile is cut into bands, whose flag is that of their first tile's centre, and these into tiles.
        tx, ty = f"(tile.tx * {CUT})", f"(tile.ty * {CUT} + i)"
        band = tile(level, tx, ty, _inside("tile", x_of(tx, side), y_of(ty, side)), near("tile.edges", tx, ty, side, CUT), True)
        z = z.where(kept).selectExpr("zone_id", f"explode(if(tile.level = {level - 1} and size(tile.edges) > {FEW_EDGES}, transform({parts}, i -> {band}), array(tile))) AS tile")
        tx, y = "(tile.tx + i)", y_of("tile.ty", side)
        passed = _odd("tile.edges", f"{_crosses('e', x_of('tile.tx', side), y)} != {_crosses('e', x_of(tx, side), y)}")
        child = tile(level, tx, "tile.ty", f"tile.inside != {passed}", near("tile.edges", tx, "tile.ty", side))
        z = z.selectExpr("zone_id", f"explode(if(tile.band, transform({parts}, i -> {child}), array(tile))) AS tile")
    return z.where(kept)


def cells_in_zones(positions: DataFrame, zones: DataFrame, all_touched: tuple[float, float] | None = None) -> DataFrame:
    """The positions (lon, lat and other columns) with the ``zone_id`` of each zone that holds their centre.

    With ``all_touched``, the cell's width and height, also of each zone whose border meets the cell.
    """
    dx, dy = (x / 2 for x in all_touched or (0.0, 0.0))
    key = lambda k: f"named_struct('level', {k}, 'tx', floor(lon / {_side(k)!r}D), 'ty', floor(lat / {_side(k)!r}D))"
    p = positions.select(F.struct(*positions.columns).alias("_p"), "lon", "lat", F.expr(f"explode(array({', '.join(map(key, range(LEVELS)))}))").alias("_k"))
    c = cover(zones, max(dx, dy)).selectExpr("zone_id", "tile", "named_struct('level', tile.level, 'tx', tile.tx, 'ty', tile.ty) AS _k")
    test = _inside("tile", "lon", "lat")
    if all_touched:
        box = f"lon - {dx!r}D", f"lat - {dy!r}D", f"lon + {dx!r}D", f"lat + {dy!r}D"
        test = f"({test}) or exists(tile.edges, e -> {_meets('e', *box)})"
    return p.join(c, "_k").where(test).select("_p.*", "zone_id")


def places_in_zones(cells: DataFrame, zones: DataFrame, all_touched: tuple[float, float] | None = None) -> DataFrame:
    """lon, lat and ``zone_id``: which positions lie in which zone, found once however often cells repeat them.

    It is kept in the shared folder. Where it is small, it is sent to all executors, so that the cells
    need not move to meet it.
    """
    where = cut(cells_in_zones(cells.select("lon", "lat").distinct(), zones, all_touched))
    return F.broadcast(where) if where.count() <= BROADCAST_ROWS else where


def _median(values: DataFrame, by: list[str]) -> DataFrame:
    """The exact median of ``value`` of each group, whatever its size.

    Values fall into buckets between a group's least and greatest one. Counting up the buckets, of which
    a group has a bounded number, finds the one that holds the middle. The values of this one are
    counted up in ranges (``ranks``). So neither values nor distinct values of a group are gathered.
    """
    same = lambda a, b, names: reduce(Column.__and__, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names))
    ends = values.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_n"))
    met = values.alias("v").join(ends.alias("e"), same("v", "e", by)).select(*(F.col(f"v.{k}").alias(k) for k in by), "value", "_lo", "_hi", "_n")
    # Halves, so that the span of the widest values is a number.
    share = (F.col("value") / 2 - F.col("_lo") / 2) / F.nullif(F.col("_hi") / 2 - F.col("_lo") / 2, F.lit(0.0))
    met = met.withColumn("_bucket", F.coalesce(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)).cast("int"))
    buckets = met.groupBy(*by, "_bucket").agg(F.count("*").alias("_m"), F.min("value").alias("_first"), F.max("value").alias("_last"), F.max("_n").alias("_n"))
    up_to = Window.partitionBy(*by).orderBy("_bucket")
    buckets = buckets.withColumn("_to", F.sum("_m").over(up_to)).withColumn("_from", F.col("_to") - F.col("_m"))
    ranks_ = F.array(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2))
    wanted = buckets.select("*", F.explode(F.array_distinct(ranks_)).alias("_rank")).where("_from < _rank and _rank <= _to")
    wanted = cut(wanted.withColumn("_at", F.when((F.col("_rank") == F.col("_from") + 1) | (F.col("_first") == F.col("_last")), F.col("_first")).when(F.col("_rank") == F.col("_to"), F.col("_last"))))
    known = wanted.where("_at is not null").select(*by, "_at")
    open_ = wanted.where("_at is null")
    if not open_.isEmpty():
        few = open_.select(*by, "_bucket", "_from").distinct()
        inner = met.alias("v").join(few.alias("e"), same("v", "e", [*by, "_bucket"])).groupBy(*(F.col(f"v.{k}").alias(k) for k in [*by, "_bucket"]), "value", F.col("e._from").alias("_from")).agg(F.count("*").alias("_m"))
        counted = ranks.running(inner, [*by, "_bucket"], [F.asc("value")], {"_upto": (F.sum, Column.__add__, "_m")}).withColumn("_upto", F.col("_upto") + F.col("_from"))
        hit = counted.alias("v").join(open_.alias("e"), same("v", "e", [*by, "_bucket"])).where("_upto - v._m < _rank and _rank <= _upto")
        known = known.unionByName(hit.select(*(F.col(f"v.{k}").alias(k) for k in by), F.col("value").alias("_at")))
    # One or two values stand in the middle.
    return known.groupBy(*by).agg((F.min("_at") / 2 + F.max("_at") / 2).alias("median"))


def zonal_statistics(cells: DataFrame, zones: DataFrame, reducers: tuple[str, ...] = ("mean",), all_touched: tuple[float, float] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of the values in each zone (and of each key); nulls are skipped, empty zones kept.

    Positions meet the zones once. Counts, sums, extremes and squared deviations are summed up for each
    position before that; a median looks at the values themselves, in a distributed selection.
    """
    if bad := set(reducers) - set(REDUCERS):
        raise ValueError(f"unknown reducers {sorted(bad)}")
    by = ["zone_id", *keys]
    valued = cells.where("value is not null").select(*keys, "lon", "lat", "value")
    plain = [r for r in reducers if r != "median"]
    where = places_in_zones(valued, zones, all_touched) if "median" in reducers else None
    stats = None
    if plain:
        per = valued.groupBy(*keys, "lon", "lat").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.var_pop("value").alias("v"))
        met = per.join(where, ["lon", "lat"]) if where is not None else cells_in_zones(per, zones, all_touched)
        n, s = F.sum("n"), F.sum("s")
        # The spread within positions, and that of their means.
        spread = F.sum(F.col("v") * F.col("n")) + F.sum(F.col("n") * (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))) - s * s / n
        made = {"count": F.coalesce(n, F.lit(0)), "sum": s, "mean": s / n, "min": F.min("lo"), "max": F.max("hi"), "std": F.sqrt(F.greatest(spread, F.lit(0.0)) / n)}
        stats = met.groupBy(*by).agg(*(made[r].alias(r) for r in plain))
    if "median" in reducers:
        middle = _median(valued.join(where, ["lon", "lat"]).select(*by, "value"), by)
        if stats is None:
            stats = middle
        else:
            a, b = stats.alias("a"), middle.alias("b")
            same = reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by))
            stats = a.join(b, same).select(*(F.col(f"a.{k}").alias(k) for k in by), *reducers)
    if keys:
        return stats
    out = zones.select("zone_id").join(stats, "zone_id", "left")
    return out.withColumn("count", F.coalesce("count", F.lit(0))) if "count" in reducers else out


def nested(stats: DataFrame, name: str, reducers: tuple[str, ...]) -> DataFrame:
    """Statistics under one property of the caller's choice."""
    return stats.select("zone_id", F.struct(*reducers).alias(name))


def point_values(cells: DataFrame, points: DataFrame, lon0: float, lat0: float, dx: float, dy: float) -> DataFrame:
    """The cells nearest to each point, over time, by equal cell indexes."""
    at = {"_ix": F.round((F.col("lon") - lon0) / dx).cast("bigint"), "_iy": F.round((F.col("lat") - lat0) / dy).cast("bigint")}
    p = points.withColumns(at).drop("lon", "lat")
    return cells.withColumns(at).join(p, ["_ix", "_iy"]).drop("_ix", "_iy")


def select_zones(zones: DataFrame, level: int | None = None, parent: str | None = None, ids: list[str] | DataFrame | None = None) -> DataFrame:
    """Zones of a level, below a parent, and of the given ids: a list, or a table of any size with a ``zone_id``."""
    out = zones if level is None else zones.where(F.col("level") == level)
    out = out if parent is None else out.where(F.col("parent_id") == parent)
    if isinstance(ids, DataFrame):
        return out.join(ids.select("zone_id"), "zone_id", "left_semi").select(zones.columns)
    return out if ids is None else out.where(F.col("zone_id").isin(ids))


def subtree(zones: DataFrame, root: str) -> DataFrame:
    """A zone and all below it, in one recursive query; a zone below itself is an error, once rows are made.

    The recursion carries ids alone. It ends at a zone that lies on its own path, which is told by the
    ids above it. The session's limit on rows of recursions is lifted.
    """
    spark = zones.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    below = spark.sql(
        """WITH RECURSIVE t(zone_id, above, again) MAX RECURSION LEVEL 100000 AS (
             SELECT zone_id, CAST(array() AS array<string>), false FROM {zones} WHERE zone_id = :root
             UNION ALL
             SELECT z.zone_id, array_append(t.above, t.zone_id), z.zone_id = t.zone_id OR array_contains(t.above, z.zone_id)
             FROM {zones} z JOIN t ON z.parent_id = t.zone_id WHERE NOT t.again)
           SELECT zone_id, bool_or(again) AS again FROM t GROUP BY zone_id""",
        args={"root": root}, zones=zones.select("zone_id", "parent_id"),
    )
    checked = below.where(F.when(F.col("again"), F.raise_error(F.concat(F.lit("below itself: "), F.col("zone_id"))).cast("boolean")).otherwise(True))
    return zones.join(checked.select("zone_id"), "zone_id", "left_semi").select(zones.columns)


def fields(zones: DataFrame, names: list[str], zone_id: str | None = None) -> DataFrame:
    """The named fields of all zones, or of one."""
    if unknown := [n for n in names if n not in zones.columns]:
        raise ValueError(f"no fields {unknown}")
    return (zones if zone_id is None else zones.where(F.col("zone_id") == zone_id)).select(*names)


def attribute_filter(zones: DataFrame, text: str) -> DataFrame:
    """Zones that meet a text predicate over the allowed columns.

    Texts stand in single quotes, a quote within them is doubled, and a backslash is one; dates are
    written ``DATE '2020-01-31'`` or ``DATE('2020-01-31')``.
    """
    import re

    quoted = r"'((?:[^']|'')*)'"
    names = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", re.sub(quoted, "''", text))}
    allowed = {*FILTER_COLUMNS, "and", "or", "not", "like", "ilike", "between", "in", "is", "null", "true", "false", "date", "timestamp"}
    if names - allowed:
        raise ValueError(f"not allowed in a filter: {sorted(names - allowed)}")
    spark_text = lambda m: "'" + m[1].replace("\\", "\\\\").replace("''", "\\'") + "'"
    return zones.where(F.expr(re.sub(quoted, spark_text, text)))


def feature_ids(features: DataFrame, id_property: str) -> DataFrame:
    """A feature's own id, or the named property."""
    return features.withColumn("zone_id", F.coalesce("id", F.col("properties")[id_property]))


def unit_values(cells: DataFrame, zones: DataFrame, resolution: str = "monthly", spatial: str = "mean", temporal: str = "sum") -> DataFrame:
    """Values of each zone and period: first over the zone's cells at each time, then over the period.

    Which cells lie in which zone is found once for each position, not for each time.
    """
    reduce_ = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "count": F.count, "std": F.stddev_pop}
    met = cells.select("lon", "lat", "time", "value").join(places_in_zones(cells, zones), ["lon", "lat"])
    if spatial == "median":  # a zone has any number of cells, a period a few times
        at_time = _median(met.where("value is not null").select("zone_id", "time", "value"), ["zone_id", "time"]).withColumnRenamed("median", "value")
    else:
        at_time = met.groupBy("zone_id", "time").agg(reduce_[spatial]("value").alias("value"))
    at_time = at_time.withColumn("period", periods.truncated(F.col("time"), resolution))
    return at_time.groupBy("zone_id", "period").agg(reduce_[temporal]("value").alias("value"))
