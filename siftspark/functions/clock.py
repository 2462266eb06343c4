"""Times and days as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_iso(at: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def from_iso(text: Column) -> Column:
    """ISO 8601 text as a timestamp; text without an offset is UTC, what is no time is null."""
    offset = F.rlike(text, F.lit(r"(?:[Zz]|[+-]\d\d:?\d\d)$"))
    return F.try_to_timestamp(F.when(offset, text).when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z"))))


def local_day(at: Column, zone: str) -> Column:
    """The calendar day of an instant in a time zone."""
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), zone))


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """The instants of a day's first midnight and of the next one: 23 or 25 hours apart where clocks change."""
    at = lambda d: F.convert_timezone(F.lit(zone), F.lit("UTC"), d.cast("timestamp_ntz"))
    return at(day), at(F.date_add(day, 1))


def day_number(day: Column) -> Column:
    """yyyymmdd as a number."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).cast("int")
