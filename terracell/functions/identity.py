"""Stable ids of managed datasets, and bounding boxes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("xmin", "ymin", "xmax", "ymax")


def bbox_text(bbox: Column) -> Column:
    """The four bounds with six decimals, comma-joined."""
    return F.concat_ws(",", *(F.format_string("%.6f", bbox[s]) for s in SIDES))


def parsed_bbox(text: Column) -> Column:
    """``xmin,ymin,xmax,ymax`` as a struct; null unless there are exactly four numbers."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    whole = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull())
    return F.when(whole, F.struct(*(parts[i].alias(s) for i, s in enumerate(SIDES))))


def adler32(text: Column) -> Column:
    """Adler-32 of ASCII text, as eight hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    start = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    step = lambda s, c: F.struct(((s["a"] + c) % 65521).alias("a"), ((s["b"] + s["a"] + c) % 65521).alias("b"))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, start, step, lambda s: s["b"] * 65536 + s["a"])), 8, "0"))


def managed_id(dataset_id: Column, extent_id: Column, bbox: Column, collection_id: Column | None = None) -> Column:
    """Dataset and extent, or a hash of the box, or ``global``; a collection id given overrides it."""
    scope = F.when(F.coalesce(extent_id, F.lit("")) != "", extent_id).when(bbox.isNotNull(), F.concat(F.lit("bbox_"), adler32(bbox_text(bbox)))).otherwise("global")
    own = F.concat_ws("_", dataset_id, scope)
    return own if collection_id is None else F.coalesce(F.nullif(collection_id, F.lit("")), own)


def scope_from_coverage(scope: Column, coverage: Column) -> Column:
    """A request scope for records without one, from what they cover."""
    made = F.struct(
        F.coalesce(coverage["temporal"]["start"], F.lit("")).alias("start"), coverage["temporal"]["end"].alias("end"),
        F.lit(None).cast("string").alias("extent_id"), F.when(coverage["spatial"].isNotNull(), coverage["spatial"]).alias("bbox"),
    )
    return F.coalesce(scope, F.when(coverage.isNotNull(), made))
