"""Relative dates, date formats and clock conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave.functions.text import col

#: Microseconds from 1601-01-01 to 1970-01-01.
BROWSER_OFFSET = 11_644_473_600_000_000

# Phrases that are a number of days.
DAYS = {"tomorrow": 1}


def _month_day(today: Column, day: int) -> Column:
    """That day of the next month."""
    return F.date_add(F.add_months(F.trunc(today, "month"), 1), day - 1)


def _first_monday(today: Column, months: int) -> Column:
    first = F.add_months(F.trunc(today, "month"), months)
    return F.next_day(F.date_sub(first, 1), "MON")


def _from_next_monday(today: Column, days: int) -> Column:
    return F.date_add(F.next_day(today, "MON"), days)


def relative_date(today: Column | str, phrase: str) -> Column:
    """The date that a phrase names on a day; null for unknown phrases. Months past December roll into the next year."""
    today = col(today).cast("date")
    if phrase in DAYS:
        return F.date_add(today, DAYS[phrase])
    weekday = F.weekday(today)  # Monday is 0
    special = {
        "this month": lambda: today,
        "5th next month": lambda: _month_day(today, 5),
        "10th next month": lambda: _month_day(today, 10),
        "11th next month": lambda: _month_day(today, 11),
        "next Monday": lambda: F.next_day(today, "MON"),
        "next Monday split": lambda: F.next_day(today, "MON"),
        "first monday four months later": lambda: _first_monday(today, 4),
        "first monday eight months later": lambda: _first_monday(today, 8),
        "this Saturday": lambda: F.date_add(today, 5 - weekday),
        "this Sunday": lambda: F.date_add(today, 6 - weekday),
        "next Friday": lambda: F.next_day(today, "FRI"),
        "next Friday split": lambda: F.next_day(today, "FRI"),
        "next Saturday": lambda: F.next_day(today, "SAT"),
        "next Sunday": lambda: F.next_day(today, "SUN"),
        "next week Friday": lambda: _from_next_monday(today, 4),
        "next week Saturday": lambda: _from_next_monday(today, 5),
        "next week Sunday": lambda: _from_next_monday(today, 6),
    }
    return special[phrase]() if phrase in special else F.lit(None).cast("date")


def relative_range(today: Column | str, start: str, end: str) -> tuple[Column, Column]:
    """Both ends of a range: an end on a weekday falls in the week of the start that names one."""
    first = relative_date(today, start)
    if end in ("next Friday", "next Friday split") and start in ("next Monday", "next Monday split"):
        return first, F.date_add(first, 4)
    if (end == "next Sunday" and start in ("next Friday", "next Saturday")) or (end == "next week Sunday" and start in ("next week Friday", "next week Saturday")):
        return first, F.date_add(first, 6 - F.weekday(first))
    return first, relative_date(today, end)


def formatted(template: str, day: Column | str) -> Column:
    """Placeholders {DoW} {Month} {DayD} {Year} {Month0D} {month} {MonthFull} {Day0D} {MonthD}, the first of each."""
    day = col(day).cast("date")
    values = {
        "DoW": F.date_format(day, "EEE"), "Month": F.date_format(day, "MMM"), "DayD": F.date_format(day, "d"), "Year": F.date_format(day, "yyyy"), "Month0D": F.date_format(day, "MM"),
        "month": F.lower(F.date_format(day, "MMMM")), "MonthFull": F.date_format(day, "MMMM"), "Day0D": F.date_format(day, "dd"), "MonthD": F.date_format(day, "M"),
    }
    # the template is known when the plan is made, so the result is one concatenation
    parts, left = [], template
    places = sorted((template.index("{" + n + "}"), n) for n in values if "{" + n + "}" in template)
    for at, name in places:
        begin = at - (len(template) - len(left))
        parts += [F.lit(left[:begin]), values[name]]
        left = left[begin + len(name) + 2 :]
    return F.concat(*parts, F.lit(left))


def browser_time(ts: Column | str) -> Column:
    """Microseconds since 1601."""
    return F.unix_micros(col(ts).cast("timestamp")) + BROWSER_OFFSET


def from_browser_time(micros: Column | str) -> Column:
    return F.timestamp_micros(col(micros) - BROWSER_OFFSET)


def parse_action_time(c: Column | str) -> Column:
    return F.try_to_timestamp(col(c), F.lit("yyyyMMdd@HHmmss"))


def action_time(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyyMMdd@HHmmss")


def chosen_zone(*zones: Column | str, default: str = "UTC") -> Column:
    """The first time zone that is named."""
    return F.coalesce(*[col(z) for z in zones], F.lit(default))


def within_minutes(a: Column | str, b: Column | str, minutes: float) -> Column:
    return F.coalesce(F.abs(F.unix_micros(col(a).cast("timestamp")) - F.unix_micros(col(b).cast("timestamp"))) <= int(minutes * 60_000_000), F.lit(False))


def is_utc_line(lines: Column | str) -> Column:
    """Whether the fourth line ends in a zero offset."""
    return F.coalesce(F.endswith(F.try_element_at(F.split(col(lines), "\n"), F.lit(4)), F.lit("+0000)")), F.lit(False))
