"""Months, seasons, dates and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    return F.to_timestamp_ntz(text) if hasattr(F, "to_timestamp_ntz") else F.to_timestamp(text)


def month_end(time: Column) -> Column:
    """Last day of the month, as a date."""
    return F.last_day(time)


def in_months(time: Column, months: Sequence[int]) -> Column:
    return F.month(time).isin(*months)


def iso_date(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def site_label(rank: Column) -> Column:
    return F.concat(F.lit("Site "), rank.cast("string"))


def coordinate_label(latitude: Column, longitude: Column) -> Column:
    return F.concat_ws(", ", F.round(latitude, 2).cast("string"), F.round(longitude, 2).cast("string"))


def display(value: Column, digits: int = 2) -> Column:
    """Rounded half to even, for output only."""
    return F.bround(value, digits)


def file_name(path: Column) -> Column:
    """Last segment of a path without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
