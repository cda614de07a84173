"""Date column functions: weekday arithmetic, holidays."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def add_weekdays(start: Column, days: Column) -> Column:
    """The n-th weekday after ``start``. Holidays count as weekdays, weekends do not.

    Closed form: a weekend start moves back to Friday, then every five days skip a weekend.
    """
    friday_based = F.least(F.weekday(start), F.lit(4))
    base = F.date_sub(start, F.weekday(start) - friday_based)
    weekends = F.floor((friday_based + days) / 5).cast("int")
    return F.date_add(base, (days + 2 * weekends).cast("int"))


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("int")


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous (Meeus/Jones/Butcher) computus."""
    golden = year % 19
    century, in_century = _div(year, 100), year % 100
    epact = (
        19 * golden + century - _div(century, 4)
        - _div(century - _div(century + 8, 25) + 1, 3) + 15
    ) % 30
    offset = (32 + 2 * (century % 4) + 2 * _div(in_century, 4) - epact - in_century % 4) % 7
    late = _div(golden + 11 * epact + 22 * offset, 451)
    serial = epact + offset - 7 * late + 114
    return F.make_date(year, _div(serial, 31), serial % 31 + 1)


def iso_date(text: Column) -> Column:
    """ISO text to date, null when it is not one."""
    return F.try_to_date(text, "yyyy-MM-dd")


def weekday_after(start: dt.date, days: int) -> dt.date:
    """The same as ``add_weekdays`` for one date on the driver."""
    base = min(start.weekday(), 4)
    return start + dt.timedelta(days=base - start.weekday() + days + 2 * ((base + days) // 5))
