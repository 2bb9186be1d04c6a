"""Period comparison and attribution of variance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept
from . import series as ser
from .ordered import first_of_each, numbered, with_totals
from .periods import at
from .rollup import UNASSIGNED, all_levels


def safe(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def level_statistics(df: DataFrame, levels: tuple[str, ...], value: str, now: dt.date, then: dt.date | None, *, lag: int = 0, pct: float = 5.0, absolute: float = 50_000.0) -> DataFrame:
    """Current against prior of every level of a hierarchy in one pass, the total being level 0.

    Shares are of the level's total. With a lag, items rank by the change of their share, else by
    their variance. Where a level has a current total but no prior one, all its variances are 0 (prior_missing).
    A level is ranked by ranges of its order, so that it may have any number of entities.
    """
    # the two periods alone are read; both sums and all levels come from one aggregation
    both = df.filter(F.col("period").isin(*[F.lit(p) for p in (now, then) if p is not None]))
    rows = all_levels(both, levels, at(now, value).alias("current"), at(then, value).alias("prior"))
    rows = kept(rows, "levels")
    missing = (F.sum(F.abs("current")) > 0) & (F.sum(F.abs("prior")) == 0)
    per = rows.groupBy("level").agg(F.sum("current").alias("_c"), F.sum("prior").alias("_p"), missing.alias("prior_missing"))  # a row a level
    rows = rows.join(F.broadcast(per), "level").withColumn("variance_dollar", F.when(F.col("prior_missing"), 0.0).otherwise(F.col("current") - F.col("prior")))
    rows = rows.withColumns({
        "variance_pct": F.when(F.col("prior_missing"), F.lit(0.0)).otherwise(safe(F.col("variance_dollar"), F.abs("prior")) * 100),
        "is_new_from_zero": (F.col("prior") == 0) & (F.col("current") != 0),
        "share_current": F.coalesce(safe(F.col("current"), F.col("_c")), F.lit(0.0)),
        "share_prior": F.coalesce(safe(F.col("prior"), F.col("_p")), F.lit(0.0)),
    })
    rows = rows.withColumn("share_change", F.col("share_current") - F.col("share_prior"))
    rows = rows.withColumn("exceeds_threshold", (F.abs("variance_dollar") >= absolute) | (F.coalesce(F.abs("variance_pct"), F.lit(0.0)) >= pct))
    rows = rows.withColumn("materiality", F.when(F.col("exceeds_threshold"), "HIGH").otherwise("LOW"))
    rows = rows.withColumns({"_by": F.abs("share_change" if lag else "variance_dollar"), "_x": F.abs("variance_dollar")})
    rows = numbered(rows, F.desc("_by"), F.col("item"), *[F.col(c) for c in levels], by=("level",), totals={"_total": "_x"}, _before="_x")
    cumulative = F.coalesce(safe(F.col("_before") + F.col("_x"), F.col("_total")) * 100, F.lit(0.0))
    return rows.withColumn("rank", F.col("row").cast("int")).withColumn("cumulative_pct", cumulative).drop("row", "_by", "_x", "_before", "_total", "_c", "_p")


def quality_flags(stats: DataFrame) -> DataFrame:
    """A row a level: whether all variances are -100 %, all are +100 % or new, or nothing is there now."""
    return stats.groupBy("level").agg(F.bool_and(F.coalesce(F.col("variance_pct") == -100, F.lit(False))).alias("all_lost"), F.bool_and(F.col("is_new_from_zero") | F.coalesce(F.col("variance_pct") == 100, F.lit(False))).alias("all_new"), (F.sum("current") == 0).alias("empty_now"))


def price_volume(df: DataFrame, item: str, total: str, volume: str, now: dt.date, then: dt.date) -> DataFrame:
    """Volume impact = change of volume at the prior price; price impact = change of price at the current volume; the rest is residual."""
    rows = df.groupBy(F.coalesce(F.col(item).cast("string"), F.lit(UNASSIGNED)).alias("item")).agg(at(now, total).alias("t1"), at(then, total).alias("t0"), at(now, volume).alias("curr_vol"), at(then, volume).alias("prior_vol"))
    price = lambda t, v: F.coalesce(safe(F.col(t), F.col(v)), F.lit(0.0))
    rows = rows.withColumn("curr_price", price("t1", "curr_vol")).withColumn("prior_price", price("t0", "prior_vol")).withColumn("total_variance", F.col("t1") - F.col("t0"))
    rows = rows.withColumn("volume_impact", (F.col("curr_vol") - F.col("prior_vol")) * F.col("prior_price")).withColumn("price_impact", (F.col("curr_price") - F.col("prior_price")) * F.col("curr_vol"))
    return rows.withColumn("residual", F.col("total_variance") - F.col("volume_impact") - F.col("price_impact")).drop("t1", "t0")


def mix_shift(df: DataFrame, segment: str, total: str, volume: str, now: dt.date, then: dt.date) -> DataFrame:
    """Weights, prices and mix effect of each segment, with the three effects of the whole on each row."""
    rows = price_volume(df, segment, total, volume, now, then).withColumnRenamed("item", "segment").withColumnsRenamed({"curr_price": "current_price", "curr_vol": "volume_current", "prior_vol": "volume_prior"})
    rows = kept(rows, "mix-segments")
    rows = with_totals(rows, v1=F.sum("volume_current"), v0=F.sum("volume_prior"), t1=F.sum(F.col("current_price") * F.col("volume_current")), t0=F.sum(F.col("prior_price") * F.col("volume_prior")), wp=F.sum(F.col("volume_prior") * F.col("current_price")))
    weight = lambda v, t: F.coalesce(safe(F.col(v), F.col(t)), F.lit(0.0))
    rows = rows.withColumn("prior_weight", weight("volume_prior", "v0")).withColumn("current_weight", weight("volume_current", "v1")).withColumn("weight_change", F.col("current_weight") - F.col("prior_weight"))
    blended0, blended1 = weight("t0", "v0"), weight("t1", "v1")
    at_old_mix = weight("wp", "v0")  # current prices at the prior weights
    rows = rows.withColumns({
        "contribution_to_mix_effect": F.col("weight_change") * F.col("current_price") * F.col("v1"),
        "volume_effect": (F.col("v1") - F.col("v0")) * blended0,
        "price_effect": (at_old_mix - blended0) * F.col("v1"),
        "mix_effect": (blended1 - at_old_mix) * F.col("v1"),
        "variance": F.col("t1") - F.col("t0"),
    })
    return rows.drop("v1", "v0", "t1", "t0", "wp", "total_variance", "volume_impact", "price_impact", "residual").withColumnRenamed("variance", "total_variance")


def bridge(df: DataFrame, entity: str, value: str, now: dt.date, then: dt.date) -> DataFrame:
    """One row: what entities that are new, lost and in both periods add to the change. An entity is there if it has a row."""
    seen = df.filter(F.col("period").isin(F.lit(now), F.lit(then))).groupBy(entity).agg(
        at(now, value).alias("c"), at(then, value).alias("p"), F.bool_or(F.col("period") == F.lit(now)).alias("is_c"), F.bool_or(F.col("period") == F.lit(then)).alias("is_p"))
    new, lost, same = F.col("is_c") & ~F.col("is_p"), ~F.col("is_c") & F.col("is_p"), F.col("is_c") & F.col("is_p")
    pick = lambda k, c: F.coalesce(F.sum(F.when(k, F.col(c))), F.lit(0.0))
    out = seen.agg(
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("total_current"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("total_prior"), pick(new, "c").alias("new_total"), pick(lost, "p").alias("lost_total"),
        pick(same, "c").alias("same_store_current"), pick(same, "p").alias("same_store_prior"), F.count_if(new).alias("new_count"), F.count_if(lost).alias("lost_count"), F.count_if(same).alias("same_store_count"))
    out = out.withColumn("total_delta", F.col("total_current") - F.col("total_prior")).withColumn("same_store_delta", F.col("same_store_current") - F.col("same_store_prior"))
    part = lambda c, sign=1: safe(sign * F.col(c), F.col("total_delta")) * 100
    return out.withColumns({"new_pct_of_delta": part("new_total"), "lost_pct_of_delta": part("lost_total", -1), "same_store_pct_of_delta": part("same_store_delta")})


def cells(df: DataFrame, entity: str, auxiliary: str, value: str, now: dt.date, then: dt.date) -> DataFrame:
    out = df.filter(F.col("period").isin(F.lit(now), F.lit(then))).groupBy(F.col(entity).alias("hierarchy_entity"), F.col(auxiliary).alias("auxiliary_value")).agg(at(now, value).alias("current"), at(then, value).alias("prior"))
    return out.withColumn("pct", safe(F.col("current") - F.col("prior"), F.abs("prior")) * 100)


def cross_cutting(two: DataFrame, *, move: float = 1.0, consistency: float = 0.6, least: int = 2) -> DataFrame:
    """Auxiliary values that push most entities the same way: a boost or a drag."""
    known = two.filter("pct IS NOT NULL")
    per = known.groupBy("auxiliary_value").agg(
        F.count("*").alias("n"), *[F.count_if(cond).alias(f"{d}_n") for d, cond in (("boost", F.col("pct") > move), ("drag", F.col("pct") < -move))], F.avg(F.when(F.col("pct") > move, F.col("pct"))).alias("boost_m"), F.avg(F.when(F.col("pct") < -move, F.col("pct"))).alias("drag_m"),
        F.sort_array(F.collect_list(F.when(F.col("pct") > move, F.col("hierarchy_entity")))).alias("boost_e"), F.sort_array(F.collect_list(F.when(F.col("pct") < -move, F.col("hierarchy_entity")))).alias("drag_e"))
    each = F.array(*[F.struct(F.lit(d).alias("effect_direction"), F.col(f"{d}_m").alias("mean_impact_pct"), F.col(f"{d}_e").alias("affected_entities"), F.col(f"{d}_n").alias("affected_entity_count"), (F.col(f"{d}_n") / F.col("n")).alias("consistency")) for d in ("boost", "drag")])
    return per.select("auxiliary_value", F.explode(each).alias("e")).select("auxiliary_value", "e.*").filter((F.col("consistency") >= consistency) & (F.col("affected_entity_count") >= least))


def residual_cells(df: DataFrame, entity: str, auxiliary: str, value: str) -> DataFrame:
    """What rows and columns of a two-way table don't explain, with its z; cells that aren't there are left out."""
    two = kept(df.groupBy(F.col(entity).alias("hierarchy_entity"), F.col(auxiliary).alias("auxiliary_value")).agg(F.sum(value).cast("double").alias("actual")), "cells")
    expected = F.avg("actual").over(Window.partitionBy("hierarchy_entity")) + F.avg("actual").over(Window.partitionBy("auxiliary_value")) - F.col("grand")
    two = with_totals(two, grand=F.avg("actual")).withColumn("expected", expected).withColumn("residual", F.col("actual") - F.col("expected"))
    two = with_totals(kept(two, "residuals"), m=F.avg("residual"), sd=F.stddev_pop("residual"))
    return two.withColumn("residual_z", (F.col("residual") - F.col("m")) / F.nullif("sd", F.lit(0.0))).drop("grand", "m", "sd")


def trends(series: DataFrame, least_r2: float = 0.3) -> DataFrame:
    """Slope and fit of each item of a dense series with three values or more other than 0."""
    out = series.groupBy("item").agg(F.regr_slope("value", F.col("period_idx").cast("double")).alias("slope"), F.regr_r2("value", F.col("period_idx").cast("double")).alias("r2"), F.count_if(F.col("value") != 0).alias("n"))
    return out.filter((F.col("n") >= 3) & (F.col("r2") >= least_r2)).drop("n")


def trend_divergence(series: DataFrame, least_r2: float = 0.3, like: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Slope and fit of each item of a dense series, the whole's slope, and whether the item diverges.

    An item counts with three values or more other than 0 and a fit of `least_r2`; it goes along with the whole if its slope has the same sign and
    between half and twice the size.
    """
    x = F.col("period_idx").cast("double")
    whole = series.groupBy("period", "period_idx").agg(F.sum("value").alias("v")).agg(F.coalesce(F.regr_slope("v", x), F.lit(0.0)).alias("overall_slope"))
    out = trends(series, 0.0).crossJoin(F.broadcast(whole))
    ratio = F.abs("slope") / F.nullif(F.abs("overall_slope"), F.lit(0.0))
    aligned = F.when(F.col("overall_slope") == 0, F.col("slope") == 0).otherwise((F.signum("slope") == F.signum("overall_slope")) & (ratio > like[0]) & (ratio < like[1]))
    direction = F.when(F.col("slope") < 0, "declining").otherwise("increasing")
    return out.withColumn("direction", direction).withColumn("diverging", (F.col("r2") >= least_r2) & ~aligned)


def period_over_period(df: DataFrame, item: str = "item", last: int | None = None) -> DataFrame:
    """Each item's value and its change from the period before; series that only accumulate are taken apart into steps first.

    last: the periods that a focus keeps, from the last one back. The first has no change; a change from 0 is 0 %.
    """
    told = kept(ser.cumulative_items(df, item), "cumulative")
    steps = ser.decumulated(df.join(told.filter("is_cumulative"), item)).select(item, "period", "value", "is_cumulative")
    plain = df.join(told.filter("NOT is_cumulative"), item).select(item, "period", "value", "is_cumulative")
    order = Window.partitionBy(item).orderBy("period")
    out = steps.unionByName(plain)
    if last is not None:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("period")))).filter(F.col("_r") <= last).drop("_r")
    before = F.lag("value").over(order)
    return out.withColumn("change", F.col("value") - before).withColumn("change_pct", F.when(before.isNotNull(), F.coalesce(safe(F.col("change"), before) * 100, F.lit(0.0))))


def delta_attribution(df: DataFrame, item: str, value: str, now: dt.date, before: dt.date) -> DataFrame:
    """Each item's two sums, its change, and that as a share of the whole change; contribution is the same with a whole of 0 counted as 1e-9."""
    rows = df.groupBy(F.col(item).alias("item")).agg(at(now, value).alias("current"), at(before, value).alias("prior")).withColumn("delta", F.col("current") - F.col("prior"))
    rows = with_totals(kept(rows, "deltas"), whole=F.sum("delta"), ends=F.sum("current") - F.sum("prior"))
    share, contribution = safe(F.col("delta"), F.col("whole")), F.col("delta") / F.when(F.col("ends") == 0, 1e-9).otherwise(F.col("ends"))
    return rows.withColumn("share", share).withColumn("contribution", contribution).drop("whole", "ends")


def bridge_periods(periods: list[dt.date], comparison: str = "MoM") -> tuple[dt.date, dt.date, str] | None:
    """(current, prior, comparison): the 13th-last period for YoY, if there are so many, else the one before the last."""
    if len(periods) < 2:
        return None
    if comparison == "YoY" and len(periods) >= 13:
        return periods[-1], periods[-13], "YoY"
    return periods[-1], periods[-2], "MoM"


def bridge_lists(df: DataFrame, entity: str, value: str, now: dt.date, then: dt.date, top: int = 5) -> DataFrame:
    """The largest new and lost entities by value, and the largest movers of those in both periods: bucket, rank, entity, current, prior, delta, delta_pct."""
    seen = df.filter(F.col("period").isin(F.lit(now), F.lit(then))).groupBy(F.col(entity).alias("entity")).agg(
        at(now, value).alias("current"), at(then, value).alias("prior"), F.bool_or(F.col("period") == F.lit(now)).alias("c"), F.bool_or(F.col("period") == F.lit(then)).alias("p"))
    seen = seen.withColumn("bucket", F.when(~F.col("p"), "new").when(~F.col("c"), "lost").otherwise("same_store")).withColumn("delta", F.col("current") - F.col("prior"))
    size = F.when(F.col("bucket") == "new", F.col("current")).when(F.col("bucket") == "lost", F.col("prior")).otherwise(F.abs("delta"))
    out = first_of_each(seen, ("bucket",), top, F.desc(size), F.col("entity"))
    return out.select("bucket", "rank", "entity", "current", "prior", "delta", F.coalesce(safe(F.col("delta"), F.col("prior")) * 100, F.lit(0.0)).alias("delta_pct"))


def material_by(stats: DataFrame, category: Column, limits: dict[str, tuple[float, float]], default: tuple[float, float] = (5.0, 50_000.0)) -> DataFrame:
    """Level statistics judged by limits (percent, amount) of each row's category, or the default ones."""
    pick = lambda k: (lambda c: c.otherwise(F.lit(default[k])))(_cases(category, {n: v[k] for n, v in limits.items()})) if limits else F.lit(default[k])
    out = stats.withColumn("limit_pct", pick(0)).withColumn("limit_amount", pick(1))
    exceeds = (F.abs("variance_dollar") >= F.col("limit_amount")) | (F.coalesce(F.abs("variance_pct"), F.lit(0.0)) >= F.col("limit_pct"))
    return out.withColumn("exceeds_threshold", exceeds).withColumn("materiality", F.when(exceeds, "HIGH").otherwise("LOW"))


def _cases(c: Column, values: dict[str, float]) -> Column:
    out = F
    for name, v in values.items():
        out = out.when(c == name, F.lit(float(v)))
    return out


def scenario_deviation(df: DataFrame, scenario: str, path: tuple[str, ...], value: str) -> DataFrame:
    """Each labelled scenario's mean against the mean of rows without a label on the same path, in percent; null where there are none."""
    v = F.col(value).cast("double")
    hit = df.filter(F.col(scenario).isNotNull()).groupBy(scenario, *path).agg(F.avg(v).alias("scenario_avg"), F.count("*").alias("rows"))
    base = df.filter(F.col(scenario).isNull()).groupBy(*path).agg(F.avg(v).alias("baseline_avg"))
    out = hit.join(base, [*path], "left")
    return out.withColumn("deviation_pct", safe(F.col("scenario_avg") - F.col("baseline_avg"), F.col("baseline_avg")) * 100)


def cross_dimension(df: DataFrame, entity: str, auxiliary: str, value: str, now: dt.date, then: dt.date, periods: list[dt.date], *, top: int = 50, least_rows: int = 1, trend_periods: int = 12) -> dict[str, DataFrame]:
    """What an auxiliary dimension adds to a hierarchy level, over its `top` values by |sum|: anova, cells, patterns, trends, and a row that sums them up.

    df: rows of period, entity, auxiliary and value; a cell counts with `least_rows` rows or more.
    """
    from .grouped import two_way
    from .periods import dense

    leaders = df.groupBy(auxiliary).agg(F.abs(F.sum(value)).alias("_s")).orderBy(F.desc("_s"), auxiliary).limit(top).select(auxiliary)
    work = kept(df.join(leaders, auxiliary, "left_semi"), "cross-dimension")
    enough = work.groupBy(entity, auxiliary).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_rows)
    parts = {
        "anova": kept(two_way(work, entity, auxiliary, value), "cross-anova"),
        "cells": residual_cells(work.join(enough, [entity, auxiliary], "left_semi"), entity, auxiliary, value).filter(F.abs("residual_z") >= 2),
        "patterns": cross_cutting(cells(work, entity, auxiliary, value, now, then)),
        "trends": trend_divergence(dense(work.filter(F.col("period").isin(periods[-trend_periods:])), auxiliary, value, periods[-trend_periods:])).filter("diverging"),
    }
    size = work.agg(F.count_distinct(auxiliary).alias("values_analyzed")).crossJoin(df.agg(F.count_distinct(auxiliary).alias("unique_values")))
    anova = parts["anova"].agg(F.max(F.when(F.col("term") == auxiliary, F.col("eta_squared"))).alias("auxiliary_eta_squared"), F.max(F.when(F.col("term") == f"{entity}:{auxiliary}", F.col("p_value"))).alias("interaction_p"))
    patterns = parts["patterns"].agg(F.count_if(F.col("effect_direction") == "boost").alias("boosts"), F.count_if(F.col("effect_direction") == "drag").alias("drags"))
    counted = lambda k, n: parts[k].agg(F.count("*").alias(n))
    row = size.crossJoin(anova).crossJoin(patterns).crossJoin(counted("cells", "anomalous_cells")).crossJoin(counted("trends", "diverging_trends"))
    parts["summary"] = row.select("unique_values", "values_analyzed", F.coalesce(F.col("auxiliary_eta_squared") > 0.05, F.lit(False)).alias("auxiliary_explains_variance"), F.coalesce(F.col("interaction_p") < 0.05, F.lit(False)).alias("interaction_significant"), "boosts", "drags", "anomalous_cells", "diverging_trends")
    return parts


def pattern_labels(df: DataFrame) -> DataFrame:
    """spike where the last value is over two deviations off the mean of the last three, else run_rate_change."""
    last = df.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("period")))).filter("r <= 3")
    per = last.groupBy("item").agg(F.max(F.when(F.col("r") == 1, F.col("value"))).alias("latest"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return per.select("item", F.when(F.abs(F.col("latest") - F.col("m")) > 2 * F.col("s"), "spike").otherwise("run_rate_change").alias("pattern"))


def growth(df: DataFrame, group: str, now: dt.date, then: dt.date, **measures: str) -> DataFrame:
    """The percent change of each measure (name=column) of each group between two periods; null without a prior amount."""
    sums = df.groupBy(group).agg(*[at(p, c).alias(f"_{n}{k}") for n, c in measures.items() for k, p in enumerate((then, now))])
    return sums.select(group, *[(100 * (safe(F.col(f"_{n}1"), F.col(f"_{n}0")) - 1)).alias(n) for n in measures])


def metric_divergence(changes: DataFrame, a: str, b: str, *, apart: float = 2.0, gap: float = 3.0, times: float = 2.0) -> DataFrame:
    """changes, with diverges (two percent changes of unlike signs, both over `apart`) and rate_mismatch (both over `gap`, one over `times` the other)."""
    x, y = F.abs(a), F.abs(b)
    opposite = (F.col(a) * F.col(b) < 0) & (x > apart) & (y > apart)
    uneven = (F.greatest(x, y) > times * F.least(x, y)) & (x > gap) & (y > gap)
    return changes.withColumns({"diverges": opposite, "rate_mismatch": uneven})


def price_yield(changes: DataFrame, total: str, volume: str) -> DataFrame:
    """changes, with the part of the total's percent change that volume leaves to price, and which of the two rose."""
    price = F.col(total) - F.col(volume)
    up, dear = F.col(volume) >= 0, price >= 0
    label = F.when(up & dear, "volume and price up").when(up, "volume up, price down").when(dear, "price up, volume down").otherwise("volume and price down")
    return changes.withColumns({"price_pct": price, "label": label})


def near_extremes(series: DataFrame, now: dt.date, *, high: float = 0.9, low: float = 1.5) -> DataFrame:
    """Each item's value of the period `now`: whether it is near the item's highest value, and near its lowest."""
    per = series.groupBy("item").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.max(F.when(F.col("period") == F.lit(now), F.col("value"))).alias("value"))
    return per.filter("value IS NOT NULL").select("item", (F.col("value") >= high * F.col("hi")).alias("near_high"), (F.col("value") <= low * F.col("lo")).alias("near_low"))


def top_share_risk(df: DataFrame, group: str, item: str, value: str, *, top: int = 3, most: float = 0.6) -> DataFrame:
    """The share of each group that its `top` items hold, and whether that is over `most`."""
    t = kept(df.groupBy(group, item).agg(F.sum(value).cast("double").alias("v")), "top-shares")
    whole = t.groupBy(group).agg(F.sum("v").alias("_whole"))
    first = first_of_each(t, (group,), top, F.desc("v"), F.col(item)).groupBy(F.col(group).alias("_g")).agg(F.sum("v").alias("_first"))
    share = safe(F.col("_first"), F.col("_whole"))
    return whole.join(first, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, share.alias("top_share"), (share > most).alias("at_risk"))


def displayed_cumulative(stats: DataFrame, top: int = 10) -> DataFrame:
    """The first `top` items of each level of level_statistics, with the running share of the movement that these items show."""
    level = Window.partitionBy("level")
    moved = F.abs("variance_dollar")
    running = F.sum(moved).over(level.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return stats.filter(F.col("rank") <= top).withColumn("shown_cumulative_pct", 100 * safe(running, F.sum(moved).over(level)))


def event_ratio(daily: DataFrame, by: str, value: str, during: tuple[str, str], before: tuple[str, str], day: str = "day") -> DataFrame:
    """The mean value of the weekdays of an event's days over that of the days before it; both spans include their ends."""
    mean = lambda span: F.avg(F.when(F.col(day).between(*[F.lit(d).cast("date") for d in span]), F.col(value)))
    return daily.filter(F.weekday(day) <= 4).groupBy(by).agg(safe(mean(during), mean(before)).alias("ratio"))


def yearly_truth(df: DataFrame, group: str, day: str, value: str, year: int) -> DataFrame:
    """A year against the one before, in all and by group: the percent change, and the rank by growth among the groups."""
    pick = lambda y: F.sum(F.when(F.year(day) == y, F.col(value))).cast("double")
    g = df.filter(F.year(day).isin(year, year - 1)).rollup(group).agg(F.grouping(group).alias("_g"), pick(year).alias("c"), pick(year - 1).alias("p"))
    placed = numbered(g.withColumn("_d", F.col("c") - F.col("p")), F.desc("_d"), F.col(group), by=("_g",))
    return placed.select(F.when(F.col("_g") == 1, "Total").otherwise(F.col(group)).alias("item"), (100 * (safe(F.col("c"), F.col("p")) - 1)).alias("yoy_pct"), F.col("row").cast("int").alias("rank"))
