"""Period buckets and date rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_end(d: Column) -> Column:
    return F.last_day(d)


def week_end_saturday(d: Column) -> Column:
    return F.date_add(d, 7 - F.dayofweek(d))


def week_end_sunday(d: Column) -> Column:
    return F.next_day(F.date_sub(d, 1), "SU")


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def year_end(d: Column) -> Column:
    return F.make_date(F.year(d), F.lit(12), F.lit(31))


def month_end_of(year: Column, month: Column) -> Column:
    """From year and month columns; months over 12 count as December."""
    return F.last_day(F.make_date(year.cast("int"), F.least(month.cast("int"), F.lit(12)), F.lit(1)))


BUCKETS = {"daily": lambda d: d, "weekly": week_end_sunday, "weekly_saturday": week_end_saturday, "monthly": month_end, "quarterly": quarter_end, "yearly": year_end}

#: Fixed values, those that contracts may use: other names of the grains; the words for one period, for its comparison, and for its end.
GRAINS = {
    "d": "daily", "day": "daily", "daily": "daily",
    "w": "weekly", "wk": "weekly", "week": "weekly", "weekly": "weekly",
    "m": "monthly", "mo": "monthly", "mon": "monthly", "month": "monthly", "monthly": "monthly",
    "q": "quarterly", "qr": "quarterly", "quarter": "quarterly", "quarterly": "quarterly",
    "y": "yearly", "yr": "yearly", "year": "yearly", "annual": "yearly", "annually": "yearly", "yearly": "yearly",
}
UNITS = {"daily": ("day", "DoD"), "weekly": ("week", "WoW"), "monthly": ("month", "MoM"), "quarterly": ("quarter", "QoQ"), "yearly": ("year", "YoY")}


def grain_of(name: str | None) -> str:
    """The grain that a label means, or `unknown`."""
    return GRAINS.get((name or "").strip().lower(), "unknown")


def unit_of(name: str | None) -> str:
    return UNITS.get(grain_of(name), ("period", "PoP"))[0]


def comparison_of(name: str | None) -> str:
    return UNITS.get(grain_of(name), ("period", "PoP"))[1]


def period_phrase(end: Column, name: str | None = None) -> Column:
    """"the month ending 2024-01-31", or what is said without a date. A time of day is left out."""
    day = F.substring_index(end.cast("string"), " ", 1)
    return F.when(F.coalesce(day, F.lit("")) == "", "the most recent period").otherwise(F.concat(F.lit(f"the {unit_of(name)} ending "), day))


def distinct_periods(df: DataFrame, period: str = "period") -> DataFrame:
    """Each period once, with its place from the first (period_idx, from 1) and from the last (from_last, from 1)."""
    once = df.select(F.col(period).alias("period")).filter("period IS NOT NULL").distinct()
    return once.withColumn("period_idx", F.row_number().over(Window.orderBy("period"))).withColumn("from_last", F.row_number().over(Window.orderBy(F.desc("period"))))


def gaps(periods: DataFrame) -> DataFrame:
    """Days since the period before, for all but the first of distinct periods."""
    return periods.withColumn("gap", F.datediff("period", F.lag("period").over(Window.orderBy("period")))).filter("gap > 0")
