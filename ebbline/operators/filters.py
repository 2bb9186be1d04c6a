"""Predicates and row filters of a contract."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import distinct_periods

#: The first date that no real period reaches.
SENTINEL = dt.date(2100, 1, 1)


def same_text(c: Column, value: str) -> Column:
    """Equal without case and outer blanks."""
    return F.lower(F.trim(c.cast("string"))) == value.strip().lower()


def in_set(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows whose columns are in the given sets, without case and outer blanks; unknown columns and empty sets don't filter."""
    for column, value in filters.items():
        values = value if isinstance(value, (list, tuple, set)) else str(value).split(",")
        values = sorted({str(v).strip().lower() for v in values if str(v).strip()})
        if column in df.columns and values:
            df = df.filter(F.lower(F.trim(F.col(column).cast("string"))).isin(*values))
    return df


def metric_filter(df: DataFrame, column: str, asked: object) -> DataFrame:
    """A list, or text with commas, means these metrics; a single text means metrics that contain it."""
    if not asked:
        return df
    if isinstance(asked, str) and "," not in asked:
        return df.filter(F.lower(F.col(column)).contains(asked.strip().lower()))
    return in_set(df, {column: asked})


def unless_empty(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet the condition, or all rows if none does."""
    found = df.filter(condition)
    return df if found.isEmpty() else found


def between_dates(c: Column, start, end) -> Column:
    return c.between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (c < F.lit(SENTINEL))


def between_months(year: Column, month: Column, start: tuple[int, int], end: tuple[int, int]) -> Column:
    after = (year > start[0]) | ((year == start[0]) & (month >= start[1]))
    before = (year < end[0]) | ((year == end[0]) & (month <= end[1]))
    return after & before


#: Days that a query looks back, by focus and grain.
WINDOWS = {None: 730, "recent": 90, "weekly": 8 * 7, "monthly": 6 * 30, "yearly": 3 * 365}


#: Periods that an analysis looks at by grain, and what a focus changes.
FOCUS_PERIODS = {"daily": 14, "weekly": 8, "monthly": 4, "quarterly": 4, "yearly": 3}
FOCUS = {"recent_weekly_trends": {"focus_periods": 8}, "recent_monthly_trends": {"focus_periods": 6}, "anomaly_detection": {"z_threshold": 1.5}, "outlier_investigation": {"z_threshold": 1.5}, "yoy_comparison": {"emphasize_yoy": True}, "forecasting": {"emphasize_forecast": True}, "revenue_gap_analysis": {"highlight_revenue_gaps": True}}


def focus_settings(modes: tuple[str, ...] = (), grain: str = "unknown") -> dict[str, object]:
    """The thresholds and windows of an analysis: the defaults of its grain, changed by each focus in turn."""
    out: dict[str, object] = {"z_threshold": 2.0, "focus_periods": FOCUS_PERIODS.get(grain, 4)}
    for name, change in FOCUS.items():
        if name in modes:
            out |= change
    return out


def window_start(end: Column, focus: str | None = None, override: int | None = None) -> Column:
    """The first day of a query's window: an override wins over the focus, and that over two years."""
    return F.date_sub(end, override if override is not None else WINDOWS.get(focus, WINDOWS[None]))


def first_day(end: dt.date, focus: str | None = None, override: int | None = None) -> dt.date:
    """The same of a known day."""
    return end - dt.timedelta(override if override is not None else WINDOWS.get(focus, WINDOWS[None]))


def month_span(first: tuple[int, int], last: tuple[int, int]) -> tuple[dt.date, dt.date]:
    """The first and the last day of a range of months (year, month)."""
    year, month = divmod(last[0] * 12 + last[1], 12)
    return dt.date(*first, 1), dt.date(year, month + 1, 1) - dt.timedelta(1)


def clamped_end(df: DataFrame, period: str, asked) -> DataFrame:
    """One row: the asked end, or the last period there is if that is earlier."""
    return df.agg(F.least(F.lit(asked).cast("date"), F.max(period)).alias("end"), F.max(period).alias("latest"))


def effective_latest(df: DataFrame, lag: int, period: str = "period") -> DataFrame:
    """One row: the period `lag` places before the last; the last if there are too few."""
    periods = distinct_periods(df, period)
    return periods.agg(F.coalesce(F.max(F.when(F.col("from_last") == lag + 1, F.col("period"))), F.max("period")).alias("period"))


def sign_corrected(df: DataFrame, key: str, value: str, prefixes: tuple[str, ...] = (), values: tuple[str, ...] = (), multiplier: int = -1) -> DataFrame:
    """Values whose key starts with a prefix, or is listed, times the multiplier; sign_flipped tells which."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(key).cast("string").startswith(p)
    if values:
        hit = hit | F.col(key).cast("string").isin(*values)
    return df.withColumn("sign_flipped", hit).withColumn(value, F.when(hit, F.col(value) * multiplier).otherwise(F.col(value)))


def classified(c: Column, policy: list[tuple[str, tuple[str, ...], tuple[str, ...]]], default: str = "specific_item") -> Column:
    """The first class whose prefixes or values fit."""
    out = None
    for name, prefixes, values in policy:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | c.cast("string").startswith(p)
        if values:
            hit = hit | c.cast("string").isin(*values)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)
