"""Business days: Monday to Friday, holidays included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def business_day_after(day: Column, n: int | Column) -> Column:
    """The ``n``-th weekday after ``day`` (n from 1), in closed form."""
    from_ = F.least(F.weekday(day), F.lit(4))  # a weekend counts from its Friday
    friday = F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
    steps = from_ + n
    return F.date_add(friday, (F.lit(n) + 2 * F.floor(steps / 5)).cast("int"))


def trading_days_between(start: Column, end: Column) -> Column:
    """Weekdays after ``start`` up to ``end``; 0 if ``end`` isn't later."""
    days = F.when(end > start, F.sequence(F.date_add(start, 1), end))
    return F.coalesce(F.size(F.filter(days, lambda d: F.weekday(d) < 5)), F.lit(0))
