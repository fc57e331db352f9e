"""What leaves the engine: files of a subset, data values, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods

FORMATS = ("parquet", "csv", "json")


def write_subset(df: DataFrame, path: str, fmt: str = "parquet", one_file: bool = False) -> None:
    """A subset as files, with a header where the format has one; as one file if it is to be handed over.

    One file is written by one task. It is sent the subset's rows only: the tables are read, and the subset
    is cut out, by as many tasks as there are splits.
    """
    if fmt not in FORMATS:
        raise ValueError(f"no export to {fmt}; one of {FORMATS}")
    (df.repartition(1) if one_file else df).write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def data_values(values: DataFrame, element: str, resolution: str, category: str | None = None, attribute: str | None = None) -> DataFrame:
    """A JSON object for each value; option combinations that are not set are left out."""
    fields = F.struct(
        F.lit(element).alias("dataElement"), periods.export_code(F.col("period"), resolution).alias("period"), F.col("zone_id").alias("orgUnit"), F.col("value").alias("value"),
        F.lit(category).cast("string").alias("categoryOptionCombo"), F.lit(attribute).cast("string").alias("attributeOptionCombo"),
    )
    return values.select(F.to_json(fields).alias("data_value"))


def run_summary(df: DataFrame, file: str, time: str = "time") -> DataFrame:
    """How many files there are, and the days that they span."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return df.agg(F.count_distinct(file).alias("file_count"), day(F.min(time)).alias("start"), day(F.max(time)).alias("end")).withColumns({"status": F.lit("completed"), "message": F.concat(F.col("file_count").cast("string"), F.lit(" files"))})
