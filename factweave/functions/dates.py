"""Calendar expressions. All economic time is `DATE`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_date(c: Column | str) -> Column:
    return F.col(c).cast("date") if isinstance(c, str) else c.cast("date")


def month_index(c: Column) -> Column:
    """Consecutive integer per calendar month."""
    return F.year(c) * 12 + F.month(c)


def quarter_index(c: Column) -> Column:
    """Consecutive integer per calendar quarter."""
    return F.year(c) * 4 + F.quarter(c) - 1


def quarter_label(index: Column) -> Column:
    """`1997Q3` for a quarter index."""
    year = F.floor(index / 4).cast("int")
    return F.concat(year.cast("string"), F.lit("Q"), (index - year * 4 + 1).cast("string"))


def quarter_start(c: Column) -> Column:
    return F.trunc(c, "quarter")


def quarter_end(c: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(c, "quarter"), 2))


def is_quarter_end(c: Column) -> Column:
    return c == quarter_end(c)


def month_day(c: Column) -> Column:
    """Month and day as one integer (0 for null), the year-free part of a date."""
    return F.coalesce(F.month(c) * 100 + F.dayofmonth(c), F.lit(0))


def calendar_signature(start: Column, end: Column) -> Column:
    """One integer for the year-free shape of a period; equal only for the same MM-dd bounds."""
    return month_day(start) * 10000 + month_day(end)


def parse_day_first(c: Column) -> Column:
    """Strict dd/MM/yyyy text; anything else gives null."""
    return F.when(
        c.rlike(r"^\d{2}/\d{2}/\d{4}$"),
        F.try_to_date(c, "dd/MM/yyyy"),
    )


def parse_year_month(c: Column) -> Column:
    """`yyyyMM` text to the last day of that month; anything else gives null."""
    text = c.cast("string")
    ok = text.rlike(r"^\d{4}(0[1-9]|1[0-2])$") & ~text.startswith("0000")
    return F.when(ok, F.last_day(F.try_to_date(F.concat(text, F.lit("01")), "yyyyMMdd")))


def exchange_date(ts_utc: Column, zone: str) -> Column:
    """Calendar date of a UTC instant in an exchange's time zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_utc.cast("timestamp_ntz")).cast("date")
