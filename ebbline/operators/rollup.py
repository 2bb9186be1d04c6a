"""Roll-ups over time and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import BUCKETS, distinct_periods, gaps
from ..plans.contract import Metric, aggregate_of, rolled
from ..sources.sinks import kept
from .ordered import with_totals

UNASSIGNED = "(Unassigned)"
ORDER = {"daily": 0, "weekly": 1, "monthly": 2, "quarterly": 3, "yearly": 4}


def current_grain(df: DataFrame, day: str) -> str:
    """daily, weekly or monthly by the median gap between dates; yearly beyond a month. Only dates are looked at."""
    gap = gaps(distinct_periods(df, day)).agg(F.percentile("gap", F.lit(0.5))).first()[0]
    return "daily" if gap is None or gap <= 1 else "weekly" if gap <= 7 else "monthly" if gap <= 31 else "yearly"


def to_grain(df: DataFrame, day: str, grain: str, keys: tuple[str, ...], metrics: tuple[Metric, ...]) -> DataFrame:
    """df at a coarser grain, each metric by its own rule; df as it is if it is as coarse already."""
    if ORDER[current_grain(df, day)] >= ORDER[grain]:
        return df
    return df.groupBy(BUCKETS[grain](F.col(day)).alias(day), *keys).agg(*[rolled(m) for m in metrics])


def long_to_grain(df: DataFrame, day: str, grain: str, keys: tuple[str, ...], metrics: tuple[Metric, ...], metric: str = "metric", value: str = "value") -> DataFrame:
    """The same for a table of metric names and values: one pass that knows each name's rule."""
    rules = {m.name: m for m in metrics}
    out = F.sum(value)
    for name, m in rules.items():
        kind = {"additive": F.max(value) if "cumulative" in m.tags else F.sum(value)}.get(m.type, F.avg(value))
        out = F.when(F.col(metric) == name, kind).otherwise(out)
    return df.groupBy(metric, BUCKETS[grain](F.col(day)).alias(day), *keys).agg(out.alias(value))


def without_children(df: DataFrame, keys: tuple[str, ...], children: tuple[str, ...], filtered: tuple[str, ...], metrics: tuple[Metric, ...]) -> DataFrame:
    """df rolled up to its parents where no filter names a child."""
    keep = [k for k in keys if k not in children or k in filtered]
    return df.groupBy(*keep).agg(*[rolled(m) for m in metrics])


def auto_weekly(df: DataFrame, day: str, keys: tuple[str, ...], metrics: tuple[Metric, ...], most: int = 100_000) -> DataFrame:
    """Daily tables of over `most` rows by weeks; others as they are."""
    return to_grain(df, day, "weekly", keys, metrics) if df.limit(most + 1).count() > most else df


def within_rows(df: DataFrame, keys: tuple[str, ...], metrics: tuple[Metric, ...], most: int) -> tuple[DataFrame, tuple[str, ...]]:
    """df rolled up by dropping the keys with most values until at most `most` rows remain, and the keys kept.

    df is aggregated once, by all keys, with what sums, maxima and means need; all else runs on that.
    """
    parts = [c for m in metrics for v in (m.column or m.name,) for c in (F.sum(v).alias(f"{m.name}__sum"), F.max(v).alias(f"{m.name}__max"), F.count(v).alias(f"{m.name}__count"))]
    base = kept(df.groupBy(*keys).agg(*parts), "row-budget")
    again = {"sum": lambda n: F.sum(f"{n}__sum"), "max": lambda n: F.max(f"{n}__max"), "avg": lambda n: F.sum(f"{n}__sum") / F.nullif(F.sum(f"{n}__count"), F.lit(0))}
    sizes = base.agg(*[F.count_distinct(k).alias(k) for k in keys]).first().asDict()
    keep = sorted(keys, key=lambda k: (sizes[k], k))
    while len(keep) > 1 and base.select(*keep).distinct().count() > most:
        keep.pop()
    return base.groupBy(*keep).agg(*[again[aggregate_of(m)](m.name).alias(m.name) for m in metrics]), tuple(keep)


def period_totals(df: DataFrame, value: str = "value") -> DataFrame:
    return df.groupBy("period").agg(F.sum(value).alias("total"))


def ratio(numerator: str, denominator: str, multiplier: float = 1.0) -> Column:
    """A ratio of aggregates, null over zero."""
    return multiplier * F.expr(numerator).cast("double") / F.nullif(F.expr(denominator).cast("double"), F.lit(0.0))


def level_sums(df: DataFrame, level: str, value: str) -> DataFrame:
    """Sums of a level, with rows that lack it under one name."""
    return df.groupBy(F.coalesce(F.col(level).cast("string"), F.lit(UNASSIGNED)).alias("item")).agg(F.sum(value).alias("total"))


def all_levels(df: DataFrame, levels: tuple[str, ...], *aggregates: Column) -> DataFrame:
    """All levels of a hierarchy, the total being level 0, in one pass over df: each input row counts in each level's grouping set, so group a fact by its leaves first."""
    prefixes = [levels[:k] for k in range(len(levels) + 1)]
    named = df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit(UNASSIGNED)) for k in levels})
    out = named.groupingSets([[F.col(c) for c in p] for p in prefixes], *levels).agg(*aggregates, *[F.grouping(c).alias(f"_{c}") for c in levels])
    level = F.lit(0)
    for k, c in enumerate(levels, 1):
        level = F.when(F.col(f"_{c}") == 0, F.lit(k)).otherwise(level)
    item = F.coalesce(*[F.col(c) for c in reversed(levels)], F.lit("Total"))
    return out.withColumn("level", level).withColumn("item", item).drop(*[f"_{c}" for c in levels])


def deduplicated_ratio(df: DataFrame, level: str, grain: tuple[str, ...], numerator: str, denominator: str, days: str | None = None) -> DataFrame:
    """numerator over a denominator that repeats on every row of a grain: its maximum per grain, then its sum, over the days if given."""
    once = df.groupBy(F.coalesce(F.col(level).cast("string"), F.lit(UNASSIGNED)).alias("item"), *grain).agg(F.sum(numerator).alias("n"), F.max(denominator).alias("d"), *([F.max(days).alias("days")] if days else []))
    below = F.sum("d").cast("double") / (F.max("days") if days else F.lit(1.0))
    return once.groupBy("item").agg(F.sum("n").cast("double").alias("numerator"), below.alias("denominator")).withColumn("ratio", F.col("numerator") / F.nullif("denominator", F.lit(0.0)))


def material(df: DataFrame, key: str, weight: str, least: float) -> DataFrame:
    """Rows of periods and keys that hold `least` of their period's weight."""
    shares = df.groupBy("period", key).agg(F.sum(weight).alias("w"))
    shares = shares.withColumn("share", F.col("w").cast("double") / F.nullif(F.sum("w").over(Window.partitionBy("period")).cast("double"), F.lit(0.0)))
    return df.join(shares.filter(F.col("share") >= least).select("period", key), ["period", key], "left_semi")


def children_of(df: DataFrame, parent: str, child: str) -> DataFrame:
    """The sorted children of each parent."""
    return df.select(parent, child).distinct().groupBy(parent).agg(F.sort_array(F.collect_list(child)).alias("children"))


def long_ratio(df: DataFrame, keys: tuple[str, ...], numerator: str, denominator: str, metric: str = "metric", value: str = "value", days: Column | None = None) -> DataFrame:
    """numerator over denominator of a long table of metric names, by keys; with `days`, over the denominator's daily mean."""
    pick = lambda m: F.sum(F.when(F.trim(metric) == m, F.col(value))).cast("double")
    below = pick(denominator) / days if days is not None else pick(denominator)
    return df.groupBy(*keys).agg((pick(numerator) / F.nullif(below, F.lit(0.0))).alias("ratio"))


def flagged_against_rest(df: DataFrame, keys: tuple[str, ...], flag: str, value: str, marks: tuple[str, ...] = ("true", "1", "yes")) -> DataFrame:
    """The mean of flagged rows and of the others, and how far the first is off in percent."""
    hit = F.lower(F.col(flag).cast("string")).isin(*[m.lower() for m in marks])
    out = df.groupBy(*keys).agg(F.avg(F.when(hit, F.col(value).cast("double"))).alias("flagged"), F.avg(F.when(~hit, F.col(value).cast("double"))).alias("baseline"))
    return out.withColumn("deviation_pct", 100 * (F.col("flagged") / F.nullif("baseline", F.lit(0.0)) - 1))


def order_summary(df: DataFrame, outer: str, inner: str, order: str, *sums: str) -> DataFrame:
    """Sums, rows (lines) and orders by outer and inner key, by outer key, and in all.

    An order is of one outer and inner key; so it is counted once there, and counts are added up.
    """
    once = df.groupBy(outer, inner, order).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("lines"))
    leaves = once.groupBy(outer, inner).agg(*[F.sum(c).alias(c) for c in (*sums, "lines")], F.count(order).alias("orders"))
    return leaves.groupingSets([[F.col(outer), F.col(inner)], [F.col(outer)], []], outer, inner).agg(*[F.sum(c).alias(c) for c in (*sums, "lines", "orders")])


def year_pair(df: DataFrame, item: str, day: str, value: str, year: int) -> DataFrame:
    """Each item's sum of a whole year and of the one before."""
    pick = lambda y: F.sum(F.when(F.year(day) == y, F.col(value))).cast("double")
    return df.filter(F.year(day).isin(year, year - 1)).groupBy(item).agg(pick(year).alias("current"), pick(year - 1).alias("prior"))


def series_summary(df: DataFrame, item: str, value: str, volatile: float = 0.2) -> DataFrame:
    """One row: periods, the first and last of them, those of the highest and lowest total, items, and how many of these vary much."""
    cells = kept(df.groupBy(item, "period").agg(F.sum(value).alias("_r"), F.sum(value).cast("double").alias("_v")), "cells")
    totals = cells.groupBy("period").agg(F.sum("_r").cast("double").alias("_v"))
    items = cells.groupBy(item).agg((F.stddev_pop("_v") / F.nullif(F.avg("_v"), F.lit(0.0))).alias("_cv")).agg(F.count("*").alias("items"), F.count_if(F.col("_cv") >= volatile).alias("high_cv"))
    spans = totals.agg(F.count("*").alias("periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.max_by("period", "_v").alias("highest_period"), F.min_by("period", "_v").alias("lowest_period"))
    return spans.crossJoin(F.broadcast(items))


def scenario_summaries(df: DataFrame, scenario: str, value: str, day: str, base: str) -> DataFrame:
    """Rows, total, mean, share and days of each scenario, and how far its mean is off that of the scenario `base` in percent."""
    t = df.groupBy(scenario).agg(F.count("*").alias("rows"), F.sum(value).cast("double").alias("total"), F.avg(F.col(value).cast("double")).alias("mean"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    t = with_totals(kept(t, "scenarios"), _all=F.sum("total"), _base=F.max(F.when(F.col(scenario) == base, F.col("mean"))))
    off = 100 * (F.col("mean") / F.nullif("_base", F.lit(0.0)) - 1)
    return t.withColumns({"share_pct": 100 * F.col("total") / F.nullif("_all", F.lit(0.0)), "deviation_pct": off}).drop("_all", "_base")


def run_metadata(df: DataFrame, entity: str) -> DataFrame:
    """One row: rows, distinct entities and distinct periods. Rows are first counted by entity and period."""
    cells = df.groupBy(entity, "period").agg(F.count("*").alias("n"))
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_distinct(entity).alias("entities"), F.count_distinct("period").alias("periods"))


def calendar_seasonality(totals: DataFrame, value: str) -> DataFrame:
    """One row: the calendar months of the highest and lowest mean of the periods' totals, and the range of these means as percent of their mean."""
    m = totals.groupBy(F.month("period").alias("m")).agg(F.avg(value).alias("v"))
    return m.agg(F.max_by("m", "v").alias("peak"), F.min_by("m", "v").alias("trough"), (100 * (F.max("v") - F.min("v")) / F.nullif(F.avg("v"), F.lit(0.0))).alias("amplitude_pct"))
