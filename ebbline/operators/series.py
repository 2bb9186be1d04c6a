"""Series rules: cumulative metrics, smoothing, rolling averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(item: str):
    return Window.partitionBy(item).orderBy("period")


def cumulative_items(df: DataFrame, item: str = "item") -> DataFrame:
    """Each item and whether its series only accumulates: six points or more, rising mostly, hardly ever falling."""
    d = df.withColumn("step", F.col("value") - F.lag("value").over(_order(item)))
    slack = F.greatest(F.lit(1e-6), F.lit(0.5) * F.percentile(F.abs("step"), F.lit(0.1)))
    per = d.groupBy(item).agg(F.count("*").alias("points"), (F.max("value") - F.min("value")).alias("range"), F.avg((F.col("step") > 0).cast("double")).alias("rises"), slack.alias("slack"))
    steady = d.join(per.select(item, "slack"), item).groupBy(item).agg(F.avg((F.col("step") >= -F.col("slack")).cast("double")).alias("steady"))
    return per.join(steady, item).select(item, ((F.col("points") >= 6) & (F.col("rises") >= 0.6) & (F.col("range") > 0) & (F.col("steady") >= 0.85)).alias("is_cumulative"))


def decumulated(df: DataFrame, item: str = "item") -> DataFrame:
    """Steps from period to period, the first value kept, none below 0."""
    step = F.coalesce(F.col("value") - F.lag("value").over(_order(item)), F.col("value"))
    return df.withColumn("value", F.greatest(step, F.lit(0.0)))


def smoothed(df: DataFrame, item: str = "item", window: int = 7, least: int = 3) -> DataFrame:
    """A trailing mean; the first periods, with too few values, take the first mean there is."""
    frame = _order(item).rowsBetween(-window + 1, 0)
    mean = F.when(F.count("value").over(frame) >= least, F.avg("value").over(frame))
    back = _order(item).rowsBetween(0, Window.unboundedFollowing)
    forward = _order(item).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_m", mean)
    return df.withColumn("smoothed", F.coalesce(F.last("_m", ignorenulls=True).over(forward), F.first("_m", ignorenulls=True).over(back))).drop("_m")


def rolling_before(df: DataFrame, item: str = "item", window: int = 4) -> DataFrame:
    """The mean of the `window` periods before each, and how far the value is from it in percent."""
    mean = F.avg("value").over(_order(item).rowsBetween(-window, -1))
    return df.withColumn("rolling_avg", mean).withColumn("vs_rolling_avg_pct", (F.col("value") - F.col("rolling_avg")) / F.nullif(F.abs("rolling_avg"), F.lit(0.0)) * 100)
