"""Period strings: 13, 10, 7 or 4 characters by period type, their bounds and successors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The length of a period string and its format, by period type.
FORMATS = {"hourly": (13, "yyyy-MM-dd'T'HH"), "daily": (10, "yyyy-MM-dd"), "monthly": (7, "yyyy-MM"), "yearly": (4, "yyyy")}
#: Periods that one chunk of the store holds, by period type.
CHUNK_PERIODS = {"hourly": 168, "daily": 30, "monthly": 12, "yearly": 1}


def _by_type(period_type: Column, made: dict[str, Column], what: str) -> Column:
    out = F.raise_error(F.concat(F.lit(f"{what} is not defined for period type "), F.coalesce(period_type, F.lit("null"))))
    for kind, column in made.items():
        out = F.when(period_type == kind, column).otherwise(out)
    return out


def period_string(time: Column, period_type: Column) -> Column:
    """A time as the string of its period; another type is an error."""
    return _by_type(period_type, {k: F.date_format(time, f) for k, (_, f) in FORMATS.items()}, "A period string")


def lower_bound(period: Column) -> Column:
    """The first instant of a full or partial date string."""
    tail = F.lit("0000-01-01T00:00:00")
    return F.try_to_timestamp(F.concat(period, F.substring(tail, F.length(period) + 1, F.lit(19))), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def upper_bound(period: Column) -> Column:
    """The first instant after a full or partial date string, by its length."""
    lo = lower_bound(period)
    step = F.when(F.length(period) == 4, F.expr("interval 1 year")).otherwise(F.expr("interval 1 month"))
    short = F.when(F.length(period) == 10, F.expr("interval 1 day")).otherwise(F.expr("interval 1 hour"))
    return F.when(F.length(period) <= 7, lo + step).otherwise(lo + short)


def next_period_start(period: Column, period_type: Column) -> Column:
    """The period after one: hourly in full with seconds, the others in their own form."""
    time = F.try_to_timestamp(F.rpad(F.concat(period, F.lit(":00:00")), 19, " "), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    made = {
        "hourly": F.date_format(time + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss"),
        "daily": F.date_format(F.date_add(F.try_to_date(period, "yyyy-MM-dd"), 1), "yyyy-MM-dd"),
        "monthly": F.date_format(F.add_months(F.try_to_date(F.concat(period, F.lit("-01")), "yyyy-MM-dd"), 1), "yyyy-MM"),
        "yearly": F.lpad((period.try_cast("int") + 1).cast("string"), 4, "0"),
    }
    return _by_type(period_type, made, "A next period")


def is_due(next_start: Column, end: Column, chronological: bool = False) -> Column:
    """Whether a period is to be fetched: not later than the end, as strings or as times."""
    return lower_bound(F.substring(next_start, 1, 13)) < upper_bound(end) if chronological else ~(next_start > end)


def export_code(time: Column, resolution: str) -> Column:
    """Period codes of data values: yyyyMMdd, ISO year and week, or yyyyMM."""
    if resolution == "weekly":
        return F.concat(F.date_format(F.date_trunc("week", time) + F.expr("interval 3 days"), "yyyy"), F.lit("W"), F.weekofyear(time).cast("string"))
    return F.date_format(time, {"daily": "yyyyMMdd", "monthly": "yyyyMM", "yearly": "yyyy"}[resolution])


def truncated(time: Column, resolution: str) -> Column:
    unit = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}[resolution]
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def time_chunk(time: Column, period_type: str) -> Column:
    """The store's chunk along time: whole periods since 1970, a fixed number to a chunk; 0 for other types."""
    months = F.year(time) * 12 + F.month(time) - 1 - 1970 * 12
    days = F.datediff(time, F.lit("1970-01-01").cast("date"))
    index = {"hourly": days * 24 + F.hour(time), "daily": days, "monthly": months, "yearly": F.year(time) - 1970}.get(period_type)
    return F.lit(0).cast("bigint") if index is None else F.floor(index / CHUNK_PERIODS[period_type]).cast("bigint")
