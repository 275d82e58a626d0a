"""Sizes and durations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_size(n: Column, gigabytes: bool = True) -> Column:
    """Bytes as B, KB (one decimal), MB or GB (two); without ``gigabytes`` MB is the largest unit."""
    size = n.cast("double")
    megabytes = F.format_string("%.2f MB", F.bround(size / 2.0**20, 2))
    return (
        F.when(size >= 2.0**30, F.format_string("%.2f GB", F.bround(size / 2.0**30, 2)) if gigabytes else megabytes)
        .when(size >= 2.0**20, megabytes)
        .when(size >= 2.0**10, F.format_string("%.1f KB", F.bround(size / 2.0**10, 1)))
        .otherwise(F.format_string("%d B", n.cast("long")))
    )


def _counted(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))


def duration_between(a: Column, b: Column) -> Column:
    """struct(days, weeks, months, years, human) between two dates, in either order.

    Months are calendar months, one less if the later day of month is smaller; the days beside
    months count what is over at 30 days a month.
    """
    first, last = F.least(a, b), F.greatest(a, b)
    days = F.datediff(last, first).cast("long")
    weeks = F.floor(days / 7).cast("long")
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    months = F.greatest(months - F.when(F.day(last) < F.day(first), 1).otherwise(0), F.lit(0)).cast("long")
    years = F.floor(months / 12).cast("long")
    human = (
        F.when(years >= 1, F.concat_ws(" ", _counted(years, "year"), _counted(months % 12, "month")))
        .when(months >= 1, F.concat_ws(" ", _counted(months, "month"), _counted(F.greatest(days - months * 30, F.lit(0)), "day")))
        .when(weeks >= 1, F.concat_ws(" ", _counted(weeks, "week"), _counted(days - weeks * 7, "day")))
        .otherwise(_counted(days, "day"))
    )
    whole = F.struct(days.alias("days"), weeks.alias("weeks"), months.alias("months"), years.alias("years"), human.alias("human"))
    return F.when(a.isNotNull() & b.isNotNull(), whole)
