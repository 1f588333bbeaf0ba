"""Half-open time scopes [start, end) by calendar grain."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

MONTHS = {"month": 1, "quarter": 3, "half_year": 6, "year": 12}


def _month(index: int) -> date:
    return date(index // 12, index % 12 + 1, 1)


def period(grain: str, day: date) -> tuple[date, date]:
    """The calendar period that holds a day."""
    size = MONTHS[grain]
    first = (day.year * 12 + day.month - 1) // size * size
    return _month(first), _month(first + size)


def recent(grain: str, n: int, today: date, most: int = 120) -> tuple[date, date]:
    """The last n periods, with the current one."""
    if not 1 <= n <= most:
        raise ValueError(f"n must be from 1 to {most}")
    start, end = period(grain, today)
    first = start.year * 12 + start.month - 1 - (n - 1) * MONTHS[grain]
    return _month(first), end


def trailing_inclusive(months: int, today: date) -> date:
    """The first day of the month so many months before the current one: months + 1 calendar months."""
    return _month(today.year * 12 + today.month - 1 - months)


def within(column: Column, scope: tuple[date, date]) -> Column:
    """A predicate the scan can push down: no function around the column."""
    return (column >= F.lit(scope[0]).cast("timestamp")) & (column < F.lit(scope[1]).cast("timestamp"))
