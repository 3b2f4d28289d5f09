"""Dates of calendars that need not be Gregorian, as integer Columns: years of 360 or 365 days, or with leap years.

A date is three integers, so that dates which no timestamp has, such as February 30th, are fine. Days are counted from
1 for the first day of year 0; months and days count from 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

IDEAL, NO_LEAP, LEAP, AUTO = "ideal", "noleap", "leap", "auto"
#: Days before each month of a year of 365 days.
BEFORE = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365]
#: Serial days of "auto": from the year 1900 on, of the years 1000 to 1899, and to the end of the year 999.
AUTO_LEAP, AUTO_NO_LEAP, AUTO_IDEAL = 1900 * 365 + 462, (1000 * 365 + 1, 1900 * 365), 1000 * 360
SECONDS = {"D": 86400, "H": 3600, "MI": 60, "S": 1}


def auto_kind(y: Column) -> Column:
    """Year 1900 on: leap; 1000 on: no leap; before: ideal."""
    return F.when(y >= 1900, LEAP).when(y >= 1000, NO_LEAP).otherwise(IDEAL)


def _by_kind(kind: str, y: Column, f) -> Column:
    if kind != AUTO:
        return f(kind)
    return F.when(y >= 1900, f(LEAP)).when(y >= 1000, f(NO_LEAP)).otherwise(f(IDEAL))


def is_leap(y: Column) -> Column:
    return (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))


def days_in_year(y: Column, kind: str = LEAP) -> Column:
    return _by_kind(kind, y, lambda k: F.lit(360) if k == IDEAL else F.lit(365) if k == NO_LEAP else F.when(is_leap(y), 366).otherwise(365))


def days_in_month(y: Column, m: Column, kind: str = LEAP) -> Column:
    sizes = F.array(*[F.lit(b - a) for a, b in zip(BEFORE, BEFORE[1:])])

    def of(k: str) -> Column:
        if k == IDEAL:
            return F.lit(30)
        plain = F.get(sizes, m - 1)
        return plain if k == NO_LEAP else F.when((m == 2) & is_leap(y), 29).otherwise(plain)

    return _by_kind(kind, y, of)


def normal_month(y: Column, m: Column) -> tuple[Column, Column]:
    """Carry months beyond 1 to 12 into the year."""
    return (y + F.floor((m - 1) / 12)).cast("long"), (F.pmod(m - 1, F.lit(12)) + 1).cast("long")


def day_of_year(y: Column, m: Column, d: Column, kind: str = LEAP) -> Column:
    before = F.array(*map(F.lit, BEFORE))

    def of(k: str) -> Column:
        if k == IDEAL:
            return (m - 1) * 30 + d
        plain = F.get(before, m - 1) + d
        return plain if k == NO_LEAP else plain + F.when((m > 2) & is_leap(y), 1).otherwise(0)

    return _by_kind(kind, y, of).cast("long")


def day_number(y: Column, m: Column, d: Column, kind: str = LEAP) -> Column:
    """Serial day of a date; months may overflow."""
    y, m = normal_month(y, m)

    def of(k: str) -> Column:
        if k == IDEAL:
            start = y * 360
        elif k == NO_LEAP:
            start = y * 365
        else:  # leap days before the year: those of 4 years, less those of 100, and those of 400 again
            start = y * 365 + F.floor((y + 3) / 4) - F.floor((y + 99) / 100) + F.floor((y + 399) / 400)
        return start + day_of_year(y, m, d, k)

    return _by_kind(kind, y, of).cast("long")


def date_of(day: Column, kind: str = LEAP) -> tuple[Column, Column, Column]:
    """Year, month and day of a serial day.

    The serial days of "auto" have gaps where its kind changes, before the years 1000 and 1900; a day in one gives NULL.
    """
    if kind not in (IDEAL, NO_LEAP, LEAP, AUTO):
        raise ValueError(f"no calendar {kind!r}")
    day = day.cast("long")
    if kind == AUTO:
        spans = [(LEAP, day >= AUTO_LEAP), (NO_LEAP, day.between(*AUTO_NO_LEAP)), (IDEAL, day <= AUTO_IDEAL)]
        none = F.lit(None).cast("long")
        y, m, d = zip(*[[F.when(within, part) for part in date_of(day, k)] for k, within in spans])
        return F.coalesce(*y, none), F.coalesce(*m, none), F.coalesce(*d, none)
    if kind == IDEAL:
        y = F.floor((day - 1) / 360)
        rest = F.pmod(day - 1, F.lit(360))
        return y.cast("long"), (F.floor(rest / 30) + 1).cast("long"), (F.pmod(rest, F.lit(30)) + 1).cast("long")
    if kind == NO_LEAP:
        y, rest = F.floor((day - 1) / 365), F.pmod(day - 1, F.lit(365))
        late = F.when(rest >= 59, rest - 59).otherwise(rest + 306)  # days since the first of March
    else:  # by cycles of 400 years that start on the first of March of year 0, so leap days are at their ends
        cycle, at = F.floor((day - 61) / 146097), F.pmod(day - 61, F.lit(146097))
        year = F.floor((at - F.floor(at / 1460) + F.floor(at / 36524) - F.floor(at / 146096)) / 365)
        late = at - (365 * year + F.floor(year / 4) - F.floor(year / 100))
        y = year + cycle * 400 + F.when(late >= 306, 1).otherwise(0)
    month = F.floor((5 * late + 2) / 153)
    m = month + F.when(month < 10, 3).otherwise(-9)
    return y.cast("long"), m.cast("long"), (late - F.floor((153 * month + 2) / 5) + 1).cast("long")


def seconds_of(duration: Column, unit: str, y: Column, m: Column, kind: str = LEAP) -> Column:
    """A duration in seconds; years and months are as long as those of the date given."""
    if unit == "Y":
        return duration * days_in_year(y, kind) * 86400
    if unit == "MO":
        return duration * days_in_month(y, m, kind) * 86400
    return duration * SECONDS[unit]


def duration_of(seconds: Column, unit: str, y: Column, m: Column, kind: str = LEAP) -> Column:
    """Seconds as a duration; years and months are as long as those of the date given."""
    return seconds / seconds_of(F.lit(1.0), unit, y, m, kind)


def day_and_second(seconds: Column) -> tuple[Column, Column]:
    """Seconds since the first day began as (serial day, second of the day); ``seconds_since`` is the other way."""
    days = F.floor(seconds / 86400)
    return days + 1, seconds - days * 86400


def seconds_since(day: Column, second: Column) -> Column:
    return (day - 1) * 86400 + second


def advance(y: Column, m: Column, d: Column, second: Column, duration: Column, unit: str, kind: str = LEAP) -> tuple[Column, Column]:
    """(serial day, second of the day) after a duration. Y and MO move the fields by its whole part, others add seconds."""
    if unit in ("Y", "MO"):
        whole = F.when(duration < 0, F.ceil(duration)).otherwise(F.floor(duration)).cast("long")
        day = day_number(y + whole, m, d, kind) if unit == "Y" else day_number(y, m + whole, d, kind)
        return day, second
    total = second + duration * SECONDS[unit]
    return day_number(y, m, d, kind) + F.floor(total / 86400), total - F.floor(total / 86400) * 86400


def hms(second: Column) -> tuple[Column, Column, Column]:
    s = second.cast("long")
    return F.floor(s / 3600), F.floor(s / 60) % 60, s % 60


def second_of(hour: Column, minute: Column, second: Column) -> Column:
    """Second of the day of a time; ``hms`` is the other way."""
    return hour * 3600 + minute * 60 + second


def passed(day: Column, second: Column, before_day: Column, before_second: Column, origin_day: Column, duration: float, unit: str, kind: str = LEAP, origin_second: Column | float = 0.0) -> Column:
    """Whether a duration has passed at a time since a time before; equal times have, and no time before the origin has.

    D, H, MI and S: a boundary of the intervals of that length, counted from the origin, lies between the two times. Y
    and MO: the dates are so far apart, a month being a twelfth of a year and a day a part of the later time's year or month.
    """
    gone = lambda dd, ss: (dd - origin_day) * 86400.0 + (ss - origin_second)
    if unit in ("Y", "MO"):
        (y, m, d), (y0, m0, d0) = date_of(day, kind), date_of(before_day, kind)
        apart = (y - y0) + (m - m0) / F.lit(12.0) + (d - d0) / days_in_year(y, kind) if unit == "Y" else (y - y0) * 12 + (m - m0) + (d - d0) / days_in_month(y, m, kind)
        far = apart >= duration
    else:
        size = F.lit(float(duration * SECONDS[unit]))
        far = F.floor(gone(day, second) / size) > F.floor(gone(before_day, before_second) / size)
    return ((day == before_day) & (second == before_second)) | ((gone(day, second) >= 0) & far)


def perpetual(day: Column, fixed: tuple[int, int, int], on: Column | bool = True, kind: str = LEAP) -> tuple[Column, Column, Column]:
    """Year, month and day of a serial day, but where ``on`` holds the ``fixed`` date, whatever the day."""
    here = on if isinstance(on, Column) else F.lit(on)
    return tuple(F.when(here, F.lit(f).cast("long")).otherwise(x) for f, x in zip(fixed, date_of(day, kind)))


#: Units from the largest to the smallest, with how many of the next one each has where that is always the same.
UNITS = {"Y": 12, "MO": None, "D": 24, "H": 60, "MI": 60, "S": 1}


def size_of(unit: str, inner: str, y: Column, m: Column, kind: str = LEAP) -> Column:
    """How many of the unit ``inner`` a larger ``unit`` has, that of the year and month given: months of a year, hours of a month, ..."""
    order = list(UNITS)
    if order.index(inner) <= order.index(unit):
        raise ValueError(f"{inner} is not smaller than {unit}")
    if unit == "Y":
        if inner == "MO":
            return F.lit(12).cast("long")
        days = days_in_year(y, kind)
    else:
        days = days_in_month(y, m, kind) if unit == "MO" else F.lit(1)
    first = order.index("D") if unit in ("Y", "MO") else order.index(unit)
    small = math.prod(UNITS[u] for u in order[first : order.index(inner)])
    return (days * small).cast("long")


def as_text(y: Column, m: Column, d: Column) -> Column:
    return F.concat(F.lpad(y.cast("string"), F.greatest(F.lit(4), F.length(y.cast("string"))), "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))


def from_text(text: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of ``yyyymmdd``; years may be longer."""
    n = F.length(text)
    return text.substr(F.lit(1), n - 4).cast("long"), text.substr(n - 3, F.lit(2)).cast("long"), text.substr(n - 1, F.lit(2)).cast("long")
