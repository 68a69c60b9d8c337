"""Dates and names as catalogs write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short_time(at: Column | str) -> Column:
    """yy-MM-dd HH:mm:ss"""
    return F.date_format(_c(at), "yy-MM-dd HH:mm:ss")


def julian_date(at: Column | str) -> Column:
    """Year and day of the year as one number, yyyyddd."""
    return (F.year(_c(at)) * 1000 + F.dayofyear(_c(at))).cast("int")


def from_julian(jdate: Column | str) -> Column:
    """The day of a yyyyddd number."""
    j = _c(jdate)
    return F.date_add(F.make_date(F.floor(j / 1000).cast("int"), F.lit(1), F.lit(1)), (j % 1000 - 1).cast("int"))


def epoch(at: Column | str) -> Column:
    return F.unix_micros(_c(at)) / 1e6


def listed(text: Column | str) -> Column:
    """The entries of a comma-separated list, without blanks around them or empty ones."""
    return F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def file_label(path: Column | str) -> Column:
    """A path's last part without its ending."""
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"\.[^.]*$", "")
