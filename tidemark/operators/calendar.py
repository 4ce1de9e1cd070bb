"""Sessions of the New York exchange by rule: weekdays without its holidays, and days that close early."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def easter(year: int) -> date:
    """Gregorian Easter Sunday."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def _observed(d: date) -> date:
    return d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d


def holidays(year: int) -> dict[date, str]:
    last_may = date(year, 5, 31)
    found = {
        _nth(year, 1, 0, 3): "Martin Luther King",
        _nth(year, 2, 0, 3): "Washington",
        easter(year) - timedelta(2): "Good Friday",
        last_may - timedelta(last_may.weekday()): "Memorial Day",
        _observed(date(year, 7, 4)): "Independence Day",
        _nth(year, 9, 0, 1): "Labor Day",
        _nth(year, 11, 3, 4): "Thanksgiving",
        _observed(date(year, 12, 25)): "Christmas",
    }
    if date(year, 1, 1).weekday() != 5:  # a Saturday's New Year isn't moved into the old year
        found[_observed(date(year, 1, 1))] = "New Year"
    if year >= 2022:
        found[_observed(date(year, 6, 19))] = "Juneteenth"
    return found


def early_closes(year: int) -> set[date]:
    days = {_nth(year, 11, 3, 4) + timedelta(1), date(year, 7, 3), date(year, 12, 24)}
    return {d for d in days if d.weekday() < 5 and d not in holidays(year)}


def sessions(spark: SparkSession, first: str, last: str) -> DataFrame:
    """session, early_close, previous and next of every trading day; a row for each day of the years asked for."""
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    closed = [(d, True) for y in range(a.year, b.year + 1) for d in holidays(y)]
    early = [(d, True) for y in range(a.year, b.year + 1) for d in early_closes(y)]
    days = spark.range(1).select(F.explode(F.sequence(F.lit(a), F.lit(b))).alias("session")).filter(F.weekday("session") < 5)
    days = days.join(F.broadcast(spark.createDataFrame(closed, "session date, closed boolean")), "session", "left_anti")
    days = days.join(F.broadcast(spark.createDataFrame(early, "session date, early_close boolean")), "session", "left")
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.lit(0)).orderBy("session")
    return days.select("session", F.coalesce("early_close", F.lit(False)).alias("early_close"), F.lag("session").over(w).alias("previous"), F.lead("session").over(w).alias("next"))
