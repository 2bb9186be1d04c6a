"""Which periods an analysis compares."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import distinct_periods, gaps
from .ordered import carried

#: Months or days back, and how many days off the target a period may be.
BACK = {"yoy": (12, 0, 7), "qoq": (3, 0, 7), "mom": (1, 0, 7), "wow": (0, 7, 3)}


def observed(df: DataFrame, period: str = "period") -> list[dt.date]:
    """All distinct periods in order. There are as many as the calendar has, whatever the size of the table."""
    return sorted(r["period"] for r in df.select(F.col(period).alias("period")).filter("period IS NOT NULL").distinct().collect())


def current(periods: list[dt.date], lag: int = 0, asked: str | None = None) -> dt.date | None:
    """The asked period by the start of its text, or that `lag` before the last (the last, if there are too few)."""
    if asked and asked != "latest":
        return next((p for p in reversed(periods) if p.isoformat().startswith(asked)), None)
    return (periods[-1 - lag] if lag < len(periods) else periods[-1]) if periods else None


def months_back(d: dt.date, months: int) -> dt.date:
    year, month = divmod(d.year * 12 + d.month - 1 - months, 12)
    last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(year, month + 1, min(d.day, last))


def prior(periods: list[dt.date], now: dt.date, kind: str = "yoy") -> dt.date | None:
    """The observed period nearest to the target, if it is near enough; week over week, else the one before."""
    months, days, tolerance = BACK[kind]
    target = months_back(now, months) - dt.timedelta(days)
    earlier = [p for p in periods if p < now]
    best = min(earlier, key=lambda p: (abs((p - target).days), p), default=None)
    if best is not None and abs((best - target).days) <= tolerance:
        return best
    return earlier[-1] if kind == "wow" and earlier else None


def pvm_prior(periods: list[dt.date], now: dt.date) -> dt.date | None:
    """Twelve periods back if there are so many, else one."""
    k = periods.index(now)
    return periods[k - 12] if k >= 12 else periods[k - 1] if k else None


def comparison_kind(df: DataFrame, asked: str = "yoy") -> str:
    """Year over year becomes week over week where the median gap is of eight days or less."""
    gap = gaps(distinct_periods(df)).agg(F.percentile("gap", F.lit(0.5))).first()[0]
    return "wow" if asked == "yoy" and gap is not None and gap <= 8 else asked


def nearest(periods: DataFrame, targets: DataFrame, tolerance: int) -> DataFrame:
    """targets (target) with the period nearest to each of at most `tolerance` days off, or null; of two as near, the earlier one. Null targets find none.

    Both kinds of days are sorted together, and each target takes the last period before it and the first one after it: no pair is compared. See carried.
    """
    known = periods.select(F.col("period").alias("at"), F.lit(True).alias("known")).filter("at IS NOT NULL").distinct()
    asked = targets.select(F.col("target").alias("at"), F.lit(False).alias("known")).filter("at IS NOT NULL").distinct()
    day = F.when(F.col("known"), F.col("at"))
    found = carried(carried(known.unionByName(asked).withColumn("day", day), "day", "before", F.col("at"), F.desc("known")), "day", "after", F.desc("at"), F.desc("known")).filter("NOT known")
    gap = lambda c: F.abs(F.datediff(c, "at"))
    closer = F.when(F.coalesce(gap("before") <= gap("after"), F.col("after").isNull()), F.col("before")).otherwise(F.col("after"))
    near = found.select("at", closer.alias("period")).filter(gap("period") <= tolerance)
    return targets.select("target").join(near, F.col("target") == F.col("at"), "left").select("target", "period")


def at(period: dt.date | None, value: str | Column) -> Column:
    """The sum of a value in one period, 0 where there is none."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(F.col("period") == F.lit(period), v)), F.lit(0)).cast("double")


def dense(df: DataFrame, item: str, value: str, periods: list[dt.date] | None = None) -> DataFrame:
    """(item, period, period_idx, value) with each period for each item, 0 where there was none.

    Rows are summed first. Each item carries the list of periods (those of df, if they aren't given), so no join makes the cells.
    """
    periods = observed(df) if periods is None else periods
    cells = df.groupBy(F.col(item).alias("item"), "period").agg(F.sum(value).cast("double").alias("value"))
    rows = cells.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("m"))
    calendar = F.array(*[F.lit(p) for p in periods])
    return rows.select("item", "m", F.posexplode(calendar).alias("period_idx", "period")).select("item", "period", (F.col("period_idx") + 1).alias("period_idx"), F.coalesce(F.try_element_at("m", "period"), F.lit(0.0)).alias("value"))


def grain(df: DataFrame, day: str, cadence: float = 0.75, anchor: float = 0.70, least: int = 8) -> DataFrame:
    """One row: the grain of a table's dates, with the shares that decide it.

    Weekly if enough gaps are of 6 to 8 days and enough dates share a weekday; monthly if enough
    gaps are of 27 to 32 days and enough dates end a month; else daily gaps, or unknown.
    """
    days = distinct_periods(df, day)
    g = gaps(days).agg(F.avg(F.col("gap").between(6, 8).cast("double")).alias("weekly"), F.avg(F.col("gap").between(27, 32).cast("double")).alias("monthly"), F.avg((F.col("gap") == 1).cast("double")).alias("daily"))
    weekdays = days.groupBy(F.dayofweek("period").alias("w")).agg(F.count("*").alias("n"), F.sum((F.col("period") == F.last_day("period")).cast("int")).alias("ends"))
    w = weekdays.agg(F.sum("n").alias("periods"), (F.max("n") / F.sum("n")).alias("weekday"), (F.sum("ends") / F.sum("n")).alias("month_end"))
    name = F.when(F.col("periods") < least, "unknown").when((F.col("weekly") >= cadence) & (F.col("weekday") >= anchor), "weekly").when((F.col("monthly") >= cadence) & (F.col("month_end") >= anchor), "monthly").when(F.col("daily") >= cadence, "daily").otherwise("unknown")
    return g.join(w).withColumn("grain", name)


def lagged(value: str, by: tuple[str, ...], k: int = 1) -> Column:
    return F.lag(value, k).over(Window.partitionBy(*by).orderBy("period"))
