"""Month arithmetic columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(c: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(c.cast("date"), "month")


def month_text(c: Column) -> Column:
    return F.date_format(c.cast("date"), "yyyy-MM")


def months_before(c: Column, months: Column | int) -> Column:
    """Month subtraction; a missing day of month clamps to the month's end."""
    n = months if isinstance(months, Column) else F.lit(months)
    return F.add_months(c.cast("date"), (-n).cast("int"))


def date_in_name(c: Column) -> Column:
    """Date written as ``YYYY_MM_DD`` in a file name; NULL when it is none."""
    text = F.regexp_extract(c, r"(\d{4}_\d{2}_\d{2})\.[A-Za-z]+", 1)
    return F.try_to_date(F.replace(text, F.lit("_"), F.lit("-")), "yyyy-MM-dd")
