"""Derived metrics: aggregate first, divide last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.contract import Kpi, checked, columns_in, kpi_parts


def ratio_parts(kpi: Kpi, by_name: dict[str, Kpi], columns: list[str], period_days: int = 1) -> tuple[Column, Column]:
    """Sums of a KPI's numerator and denominator, each a row-level expression over known columns."""
    n, d = kpi_parts(kpi, by_name, period_days)
    sum_of = lambda e: F.sum(checked(e, columns)) if columns_in(e) else F.lit(float(eval_number(e)))
    return sum_of(n), sum_of(d)


def eval_number(expression: str) -> float:
    """A product of numbers, as a denominator without columns is."""
    out = 1.0
    for part in expression.replace("(", " ").replace(")", " ").split("*"):
        out *= float(part)
    return out


def derived_series(df: DataFrame, keys: tuple[str, ...], kpis: tuple[Kpi, ...], by_name: dict[str, Kpi], period_days: int = 1) -> DataFrame:
    """One row a period (and keys): each KPI as a ratio of sums, null over zero."""
    parts = {k.name: ratio_parts(k, by_name, df.columns, period_days) for k in kpis}
    sums = df.groupBy("period", *keys).agg(*[c.cast("double").alias(f"{n}_{s}") for n, two in parts.items() for c, s in zip(two, "nd", strict=True)])
    return sums.select("period", *keys, *[(F.col(f"{n}_n") / F.nullif(F.col(f"{n}_d"), F.lit(0.0))).alias(n) for n in parts])


def with_trend(series: DataFrame, value: str, goal: str = "maximize", worse: float = 5.0) -> DataFrame:
    """Change from the period before in percent, and whether it is a turn for the worse by the metric's goal."""
    before = F.lag(value).over(Window.orderBy("period"))
    trend = (F.col(value) - before) / F.nullif(F.abs(before), F.lit(0.0)) * 100
    bad = {"maximize": F.col("trend_pct") < -worse, "minimize": F.col("trend_pct") > worse, "neutral": F.lit(False)}[goal]
    return series.withColumn("trend_pct", trend).withColumn("degraded", F.coalesce(bad, F.lit(False)))


def sequential(totals: DataFrame, kpis: tuple[Kpi, ...], period_days: Column) -> DataFrame:
    """KPIs over one row of totals a period; a later KPI may name an earlier one."""
    for k in kpis:
        of = lambda x: period_days if x == "period_days" else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x).cast("double")
        value = of(k.numerator)
        for s in k.subtract:
            value = value - of(s)
        if k.add:
            value = value + of(k.add)
        for below in (k.denominator, k.divide_by):
            if below is not None:
                value = value / F.nullif(of(below), F.lit(0.0))
        totals = totals.withColumn(k.name, value * of(k.multiply) if k.multiply is not None else value)
    return totals


def utilisation(series: DataFrame, value: str, last: int = 13) -> DataFrame:
    """The last periods against the series' mean: OK down to -5 %, WARNING down to -10 %, else DEGRADED."""
    s = series.crossJoin(F.broadcast(series.agg(F.avg(value).alias("mean"))))
    s = s.withColumn("vs_mean_pct", (F.col(value) - F.col("mean")) / F.nullif(F.abs("mean"), F.lit(0.0)) * 100)
    status = F.when(F.col("vs_mean_pct") >= -5, "OK").when(F.col("vs_mean_pct") >= -10, "WARNING").otherwise("DEGRADED")
    s = s.withColumn("status", status).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("period"))))
    return s.filter(F.col("_r") <= last).drop("_r")


def degradations(series: DataFrame, value: str, goal: str = "maximize", back: int = 3, worse: float = 5.0) -> DataFrame:
    """Periods in which a metric is worse by over `worse` percent than the mean of the `back` periods before: period, current, baseline, variance_pct."""
    base = F.avg(value).over(Window.orderBy("period").rowsBetween(-back, -1))  # periods of one metric
    s = series.select("period", F.col(value).cast("double").alias("current"), base.alias("baseline"), F.lag(value, back).over(Window.orderBy("period")).alias("_full"))
    s = s.filter("_full IS NOT NULL").withColumn("variance_pct", (F.col("current") - F.col("baseline")) / F.nullif(F.abs("baseline"), F.lit(0.0)) * 100).drop("_full")
    return s.filter({"maximize": F.col("variance_pct") < -worse, "minimize": F.col("variance_pct") > worse, "neutral": F.lit(False)}[goal])


def value_outliers(series: DataFrame, value: str, least: float = 2.0) -> DataFrame:
    """Periods whose value lies `least` deviations off the series' mean: period, value, mean, z_score."""
    whole = series.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd"))
    s = series.crossJoin(F.broadcast(whole)).withColumn("z_score", (F.col(value) - F.col("mean")) / F.nullif("_sd", F.lit(0.0)))
    return s.filter(F.abs("z_score") >= least).select("period", F.col(value).cast("double").alias("value"), "mean", "z_score")
