"""Series of a cell: running totals, spells, other periods, other units, and steps by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods

CELL = ("dataset_id", "lon", "lat")
#: Factor and offset from one unit to another.
CONVERSIONS = {("kelvin", "degC"): (1.0, -273.15), ("m", "mm"): (1000.0, 0.0)}


def deaccumulate(df: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Steps of totals that start anew each day, the value at midnight closing the day before."""
    day = F.to_date(F.col("time") - F.expr("interval 1 hour"))
    before = F.lag("value").over(Window.partitionBy(*keys, "_day").orderBy("time"))
    return df.withColumn("_day", day).withColumn("value", F.col("value") - F.coalesce(before, F.lit(0.0))).drop("_day")


def spell_length(df: DataFrame, threshold: float, keys: tuple[str, ...] = CELL) -> DataFrame:
    """The most days in a row on which a daily series is above a threshold."""
    days = df.where(F.col("value") > threshold).select(*keys, F.to_date("time").alias("_day")).distinct()
    island = F.date_sub("_day", F.row_number().over(Window.partitionBy(*keys).orderBy("_day")))
    return days.withColumn("_island", island).groupBy(*keys, "_island").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("longest_spell"))


def sums_in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A sum of ``value`` for each key, added up row by row in the given order, with the first row's ``order``.

    The last places of a sum of floats depend on the order of its rows, which is another one each time
    that ``F.sum`` meets them behind a shuffle. A value that is held against a threshold needs one order.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = df.select(*keys, *order, F.row_number().over(w).alias("_n"), so_far.alias("_so_far"))
    return rows.groupBy(*keys).agg(*(F.min_by(c, "_n").alias(c) for c in order), F.max_by("_so_far", "_n").alias("value"))


def resample(df: DataFrame, resolution: str, reducer: str = "sum", keys: tuple[str, ...] = CELL, order: list[str] | None = None) -> DataFrame:
    """A series of longer periods; sums are added up in the order of the columns ``order``, if given, so that each run ends in the same float."""
    if order and reducer == "sum":
        return sums_in_order(df.withColumn("time", periods.truncated(F.col("time"), resolution)), [*keys, "time"], order).drop(*order)
    reduce_ = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median}[reducer]
    return df.groupBy(*keys, periods.truncated(F.col("time"), resolution).alias("time")).agg(reduce_("value").alias("value"))


def convert_units(df: DataFrame, units: str, to: str | None) -> DataFrame:
    """Values in another unit; a pair that is not known is an error."""
    if to is None or to == units:
        return df
    if (units, to) not in CONVERSIONS:
        raise ValueError(f"no conversion from {units} to {to}")
    factor, offset = CONVERSIONS[units, to]
    return df.withColumn("value", F.col("value") * F.lit(factor) + F.lit(offset))


def conversions(spark: SparkSession) -> DataFrame:
    """The known conversions as a table."""
    return spark.createDataFrame([(a, b, *c) for (a, b), c in CONVERSIONS.items()], "units string, convert_units string, factor double, offset double")


def convert_by_row(df: DataFrame, conversions: DataFrame) -> DataFrame:
    """Values in the unit that each row's ``convert_units`` names; a row whose pair is not in the table is an error.

    ``conversions``: units, convert_units, factor and offset. Rows that name no unit, or their own, stay.
    """
    out = df.join(conversions, ["units", "convert_units"], "left")
    same = F.col("convert_units").isNull() | (F.col("convert_units") == F.col("units"))
    lost = F.raise_error(F.concat(F.lit("no conversion from "), F.coalesce("units", F.lit("none")), F.lit(" to "), F.col("convert_units"))).cast("double")
    value = F.when(same, F.col("value")).when(F.col("factor").isNotNull(), F.col("value") * F.col("factor") + F.col("offset")).otherwise(lost)
    return out.withColumn("value", value).select(df.columns)


STEPS: dict[str, Callable[..., DataFrame]] = {"deaccumulate_era5": deaccumulate, "resample_daily": lambda df: resample(df, "daily"), "convert_units": convert_units, "spell_length": spell_length}


def processed(df: DataFrame, steps: list[str | tuple]) -> DataFrame:
    """The named steps in their order; a step that takes arguments is a tuple of its name and these."""
    for step in steps:
        name, *arguments = (step,) if isinstance(step, str) else step
        if name not in STEPS:
            raise ValueError(f"no step {name}")
        df = STEPS[name](df, *arguments)
    return df


def template_steps(template: dict) -> list[str | tuple]:
    """What a template asks for: its steps, then its change of units."""
    steps = list(template.get("pre_process") or [])
    to = template.get("convert_units")
    return steps + [("convert_units", template["units"], to)] if to else steps
