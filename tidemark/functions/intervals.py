"""Interval strings such as ``6 months``, ``1y`` or ``all``, and calendar steps with them."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the short unit names mean. A lone ``m`` is a minute, not a month.
SHORT_UNITS = {"y": "year", "d": "day", "w": "week", "h": "hour", "m": "minute", "s": "second", "ms": "microsecond"}
LONG_UNITS = ("year", "month", "day", "week", "hour", "minute", "second", "microsecond")


def parse_interval(text: str) -> tuple[int, str]:
    """``"6months"`` to ``(6, "month")``; raises ``ValueError`` for anything else."""
    found = re.fullmatch(r"(\d+) *([^ ]+)", text)
    if not found:
        raise ValueError(f"not an interval: {text!r}")
    number, unit = int(found[1]), found[2]
    if unit in LONG_UNITS:
        return number, unit
    if unit.endswith("s") and unit[:-1] in LONG_UNITS:
        return number, unit[:-1]
    if unit.lower() in SHORT_UNITS:
        return number, SHORT_UNITS[unit.lower()]
    raise ValueError(f"unknown unit in interval: {text!r}")


def shift(moment: datetime, text: str, times: int = 1) -> datetime:
    """``moment`` plus ``times`` intervals; months end on a day that they have."""
    number, unit = parse_interval(text)
    if unit not in ("year", "month"):
        return moment + timedelta(**{f"{unit}s": number}) * times
    months = moment.year * 12 + moment.month - 1 + times * number * (12 if unit == "year" else 1)
    year, month = divmod(months, 12)
    return moment.replace(year=year, month=month + 1, day=min(moment.day, monthrange(year, month + 1)[1]))


def back(moment: Column, text: str) -> Column:
    """``moment`` minus the interval, in the plan."""
    number, unit = parse_interval(text)
    return moment - F.expr(f"interval {number} {unit}")


def ahead(moment: Column, text: str) -> Column:
    number, unit = parse_interval(text)
    return moment + F.expr(f"interval {number} {unit}")


def slug(text: str) -> str:
    """The interval as part of a column name."""
    return text.replace(" ", "")
