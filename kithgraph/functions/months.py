"""Month arithmetic on YYYY-MM strings, and their places on a time line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(month: Column) -> Column:
    return F.left(month, F.lit(4)).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def from_index(i: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"))


def add_months(month: Column, n: Column) -> Column:
    return from_index(month_index(month) + n.cast("int"))


def month_label(month: Column) -> Column:
    return F.date_format(F.to_date(F.concat(month, F.lit("-01"))), "MMM yyyy")


def month_x(month: Column, origin: Column, width: float) -> Column:
    return (month_index(month) - month_index(origin)) * width


def x_month(x: Column, origin: Column, width: float) -> Column:
    return from_index(month_index(origin) + F.floor(x / width).cast("int"))


def day_x(day: Column, origin: Column, width: float) -> Column:
    """Place of a date, part of the month by its day."""
    share = (F.dayofmonth(day) - 1) / F.dayofmonth(F.last_day(day))
    return (F.year(day) * 12 + F.month(day) - 1 - month_index(origin) + share) * width
