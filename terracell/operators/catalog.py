"""The catalog: artifacts, managed datasets and their versions, templates, extents, publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from . import ranks
from .resolve import resolve_by_key

PAGE, LARGEST_PAGE = 20, 50


def with_managed_id(artifacts: DataFrame) -> DataFrame:
    scope = F.col("request_scope")
    return artifacts.withColumn("managed_id", identity.managed_id(F.col("dataset_id"), scope["extent_id"], scope["bbox"], F.col("publication.collection_id")))


def upgraded(artifacts: DataFrame) -> DataFrame:
    """Records without a request scope get one from what they cover."""
    return artifacts.withColumn("request_scope", identity.scope_from_coverage(F.col("request_scope"), F.col("coverage")))


def latest(artifacts: DataFrame, key: str = "managed_id") -> DataFrame:
    """Of each managed dataset the record created last; of those, the one stored first.

    Records without a ``managed_id`` get theirs here: of each scope the latest record comes first, so that
    boxes are hashed once a scope and not once a record.
    """
    order = [F.desc("created_at"), F.asc("seq")]
    if key == "managed_id" and key not in artifacts.columns:
        scope = {"_dataset": "dataset_id", "_extent": "request_scope.extent_id", "_box": "request_scope.bbox", "_collection": "publication.collection_id"}
        named = artifacts.withColumns({n: F.col(c) for n, c in scope.items()})
        artifacts = with_managed_id(resolve_by_key(named, list(scope), order).drop(*scope))
    return resolve_by_key(artifacts, [key], order)


def current_versions(artifacts: DataFrame) -> DataFrame:
    """Records are replaced by appending a higher ``version_seq``; the highest of each counts."""
    return resolve_by_key(artifacts, ["artifact_id"], [F.desc("version_seq")])


#: What a template may say about a dataset; anything that is no text counts as not said.
DESCRIBED = ("short_name", "period_type", "units", "resolution", "source", "source_url")


def described(artifacts: DataFrame, templates: DataFrame) -> DataFrame:
    """The latest record of each managed dataset, with what its template says of it if there is one."""
    said = dict(templates.dtypes)
    text = [(F.col(c) if said.get(c) == "string" else F.lit(None).cast("string")).alias(c) for c in DESCRIBED]
    rows = latest(artifacts).drop(*DESCRIBED).join(templates.select("dataset_id", *text), "dataset_id", "left")
    return rows.withColumn("period_type", F.coalesce("period_type", F.lit("unknown")))


def datasets(artifacts: DataFrame, templates: DataFrame) -> DataFrame:
    """The catalog as it is shown: one row for each managed dataset, by its id, without internal ids and paths."""
    p = F.col("publication")
    return described(artifacts, templates).select(
        F.col("managed_id").alias("dataset_id"), F.col("dataset_id").alias("source_dataset_id"), "dataset_name", "variable", *DESCRIBED,
        F.col("coverage").alias("extent"), F.col("created_at").alias("last_updated"), F.struct(p["status"].alias("status"), p["published_at"].alias("published_at")).alias("publication"),
    ).orderBy("dataset_id")


def page(df: DataFrame, key: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(min(limit, LARGEST_PAGE))


def version_history(artifacts: DataFrame) -> DataFrame:
    """Versions of each managed dataset with their place, newest first; ties as they were stored.

    Places are found in ranges, so that a dataset with very many versions is spread over tasks.
    """
    return ranks.placed(artifacts, ["managed_id"], [F.desc("created_at"), F.asc("seq")], "version_no")


def dataset_details(artifacts: DataFrame, fields: list[str], page: int = PAGE) -> DataFrame:
    """Versions of each managed dataset, newest first, in pages: ``managed_id``, ``page`` (from 0) and the array ``versions``."""
    numbered = version_history(artifacts).withColumn("_page", F.floor((F.col("version_no") - 1) / page).cast("bigint"))
    item = F.struct(F.col("version_no").alias("_no"), F.struct(*fields).alias("version"))
    out = numbered.groupBy("managed_id", F.col("_page").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("versions"))
    return out.withColumn("versions", F.transform("versions", lambda v: v["version"]))


def matched_requests(requests: DataFrame, templates: DataFrame, extents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with template and extent, and those that name an unknown one, with the reason."""
    known = requests.join(templates.select("dataset_id"), "dataset_id", "left_semi")
    lost = requests.join(templates.select("dataset_id"), "dataset_id", "left_anti").withColumn("reason", F.lit("unknown dataset"))
    boxes = extents.select(F.col("id").alias("extent_id"), F.col("bbox").alias("extent_bbox"), "country_code")
    stray = known.where("extent_id is not null").join(boxes, "extent_id", "left_anti").withColumn("reason", F.lit("unknown extent"))
    found = known.join(boxes, "extent_id", "left").where("extent_id is null or extent_bbox is not null")
    return found, lost.unionByName(stray)


def spatial_arguments(requests: DataFrame, default_bbox: str | None = None, default_country: str | None = None, bounds: tuple[float, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Box and country of each request: its own, the configured one, the zones' bounds; and the rest with reasons."""
    lit_box = F.struct(*(F.lit(float(b)).alias(s) for b, s in zip(bounds, identity.SIDES))) if bounds else F.lit(None)
    box = F.coalesce("bbox", identity.parsed_bbox(F.lit(default_bbox)) if default_bbox else F.lit(None), lit_box)
    out = requests.withColumns({"bbox": box, "country_code": F.coalesce("country_code", F.lit(default_country))})
    missing = F.when(F.col("bbox").isNull(), "no bounding box").when(F.col("country_code").isNull(), "no country code")
    return out.where("bbox is not null and country_code is not null"), out.withColumn("reason", missing).where("reason is not null")


def dedup_lookup(artifacts: DataFrame, requests: DataFrame, scope: list[str], prefer_zarr: bool = False) -> DataFrame:
    """Of each request the newest artifact of the same dataset and scope."""
    stored = artifacts.where("format = 'zarr'") if prefer_zarr else artifacts
    # One row of each dataset and scope: a request meets one artifact at most.
    newest = stored.groupBy("dataset_id", *scope).agg(F.max("seq").alias("seq"))
    a, r = newest.alias("a"), requests.alias("r")
    same = F.col("a.dataset_id") == F.col("r.dataset_id")
    for c in scope:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"r.{c}"))
    found = r.join(a, same).select("r.request_id", F.col("a.seq").alias("seq"))
    return found.groupBy("request_id").agg(F.max("seq").alias("seq"))


def new_requests(artifacts: DataFrame, requests: DataFrame, scope: list[str], prefer_zarr: bool = False) -> DataFrame:
    """Requests for which nothing of the same dataset and scope is stored."""
    stored = artifacts.where("format = 'zarr'") if prefer_zarr else artifacts
    a, r = stored.select("dataset_id", *scope).distinct().alias("a"), requests.alias("r")
    same = F.col("a.dataset_id") == F.col("r.dataset_id")
    for c in scope:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"r.{c}"))
    return r.join(a, same, "left_anti")


def datasets_of(ingestions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each ingestion's managed dataset, as its latest record describes it."""
    managed = ingestions.select("artifact_id").join(artifacts.select("artifact_id", "managed_id"), "artifact_id")
    return managed.join(latest(artifacts).drop("artifact_id"), "managed_id")


def append_records(records: DataFrame, path: str) -> None:
    """Store records; one that is there already is replaced by its higher ``version_seq``."""
    records.write.mode("append").parquet(path)


def replacing(records: DataFrame, changed: DataFrame) -> DataFrame:
    """What to append so that the changed records take the place of those of the same id."""
    last = records.groupBy("artifact_id").agg(F.max("version_seq").alias("_last"))
    next_ = changed.drop("version_seq").join(last, "artifact_id", "left")
    return next_.withColumn("version_seq", F.coalesce("_last", F.lit(0)) + 1).select(records.columns)


def published(artifacts: DataFrame, as_of: Column) -> DataFrame:
    """Records as they stand once published; those that are published already stay as they are."""
    p = F.col("publication")
    now = F.struct(F.lit("published").alias("status"), F.col("managed_id").alias("collection_id"), as_of.cast("timestamp").alias("published_at"), F.concat(F.lit("/ogcapi/collections/"), F.col("managed_id")).alias("path"))
    return artifacts.withColumn("publication", F.when(p["status"] == "published", p).otherwise(now))


def updated_publications(artifacts: DataFrame, changes: DataFrame) -> DataFrame:
    """Artifacts with the publications that ``changes`` has for their ids."""
    new = changes.select("artifact_id", F.col("publication").alias("_new"))
    return artifacts.join(new, "artifact_id", "left").withColumn("publication", F.coalesce("_new", "publication")).drop("_new")


def published_collections(artifacts: DataFrame) -> DataFrame:
    """Published records by managed id; of several, the one stored last."""
    return resolve_by_key(artifacts.where("publication.status = 'published'"), ["managed_id"], [F.desc("seq")])


def collection_metadata(collections: DataFrame) -> DataFrame:
    """One nested record for each published dataset."""
    space = F.struct(F.array(*(F.col(f"coverage.spatial.{s}") for s in identity.SIDES)).alias("bbox"))
    time = F.struct(F.col("coverage.temporal.start").alias("begin"), F.col("coverage.temporal.end").alias("end"))
    return collections.select(F.struct(F.col("managed_id").alias("id"), F.col("dataset_name").alias("title"), F.array("dataset_id", "variable").alias("keywords"), F.struct(space.alias("spatial"), time.alias("temporal")).alias("extents"), "format").alias("collection"))


def template_union(files: list[DataFrame]) -> DataFrame:
    """Templates of several files, in their order; of equal ids the last one counts."""
    every = None
    for i, f in enumerate(files):
        f = f.withColumn("_file", F.lit(i))
        every = f if every is None else every.unionByName(f, allowMissingColumns=True)
    return resolve_by_key(every, ["id"], [F.desc("_file"), F.desc("position")]).drop("_file")


def first_extents(extents: DataFrame) -> DataFrame:
    """Of equal ids the first one counts; entries without an id are none."""
    return resolve_by_key(extents.where("id is not null"), ["id"], [F.asc("position")])


def valid_extents(extents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extents as they are shown (no country code), and those whose box is not four numbers."""
    box = F.transform("bbox", lambda x: x.cast("string").try_cast("double"))
    ok = F.coalesce((F.size("bbox") == 4) & F.forall(box, lambda x: x.isNotNull()), F.lit(False))
    return extents.where(ok).select("id", "name", "description", box.alias("bbox")), extents.where(~ok).withColumn("reason", F.lit("invalid bbox"))
