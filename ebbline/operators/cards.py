"""Insight cards of the statistical analyses: fifteen builders, each from an operator's own columns.

A card has title, period (null if it is of none), priority, score, and recent, whether its period is among the latest.
What the analyses found is already bounded (items, periods, metrics); cards only project it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alerts import composite, label, magnitude_score, materiality_weight, statistical_score


def card(df: DataFrame, title: Column, score: Column, *, period: Column | None = None, priority: Column | None = None, recent: Column | None = None) -> DataFrame:
    s = F.round(F.least(score, F.lit(1.0)), 4)
    return df.select(title.alias("title"), (F.lit(None) if period is None else period).cast("date").alias("period"), (label(s) if priority is None else priority).alias("priority"), s.alias("score"), F.coalesce(recent if recent is not None else F.lit(False), F.lit(False)).alias("recent"))


def text(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def anomalies(z: DataFrame, recent: list | None = None) -> DataFrame:
    """z: item, period, value, avg, z_score, share."""
    pct = 100 * (F.col("value") - F.col("avg")) / F.nullif(F.abs("avg"), F.lit(0.0))
    far = lambda k: F.abs("z_score") >= k
    grave = F.when(far(4), "critical").when(far(3), "high").when(far(2), "medium").otherwise("low")
    score = composite(statistical_score(z=F.col("z_score")), magnitude_score(pct), materiality_weight(F.col("share")))
    return card(z.filter(far(2.0)), text("Anomaly: ", F.col("item"), " in ", F.col("period").cast("string")), score, period=F.col("period"), priority=grave, recent=F.col("period").isin(*recent) if recent else None)


def correlations(pairs: DataFrame) -> DataFrame:
    """pairs: a, b, r, p_value."""
    return card(pairs.filter((F.abs("r") >= 0.7) & (F.col("p_value") < 0.05)), text("Correlation: ", F.col("a"), " vs ", F.col("b")), F.abs("r") * 0.5)


def trends(profiles: DataFrame) -> DataFrame:
    """profiles: item, avg, slope_3mo, slope_3mo_p_value, share."""
    p = profiles.filter(F.col("slope_3mo_p_value") < 0.10)
    size = F.coalesce(magnitude_score(100 * F.col("slope_3mo") / F.nullif("avg", F.lit(0.0))), F.lit(0.5))
    way = F.when(F.col("slope_3mo") > 0, "Increasing").otherwise("Decreasing")
    return card(p, text("Trend: ", F.col("item"), " -- ", way), composite(statistical_score(p=F.col("slope_3mo_p_value")), size, materiality_weight(F.col("share"))))


def volatility(profiles: DataFrame) -> DataFrame:
    """profiles: item, cv, share."""
    return card(profiles.filter("cv > 0.2"), text("High Volatility: ", F.col("item")), composite(statistical_score(cv=F.col("cv")), F.lit(0.3), materiality_weight(F.col("share"))))


def change_points(changes: DataFrame) -> DataFrame:
    """changes: item, period, magnitude_pct, before_mean, confidence_score, share."""
    size = F.when(F.col("before_mean") == 0, 0.5).otherwise(magnitude_score(F.col("magnitude_pct")))
    score = composite(statistical_score(confidence=F.col("confidence_score")), size, materiality_weight(F.col("share")))
    return card(changes, text("Structural Break: ", F.col("item"), " at ", F.col("period").cast("string")), score, period=F.col("period"))


def forecasts(misses: DataFrame) -> DataFrame:
    """misses: item, period, variance_pct of hold-out forecasts."""
    return card(misses.filter("miss"), text("Forecast Deviation: ", F.col("item"), " in ", F.col("period").cast("string")), magnitude_score(F.col("variance_pct")) * 0.6, period=F.col("period"))


def seasonal_anomalies(parts: DataFrame, least: float = 1.5) -> DataFrame:
    """parts: item, period, residual_z of seasonal parts."""
    return card(parts.filter(F.abs("residual_z") >= least), text("Seasonal Anomaly: ", F.col("item"), " in ", F.col("period").cast("string")), statistical_score(z=F.col("residual_z")) * 0.5, period=F.col("period"))


def bridges(bridge: DataFrame) -> DataFrame:
    """bridge: the one row of variance.bridge. Churn, new, lost and continuing entities."""
    c = F.col
    churn = F.abs("new_total") + F.abs("lost_total")
    pct = churn / F.nullif(F.abs("total_delta"), F.lit(0.0)) * 100
    organic = F.least(F.coalesce(F.abs("same_store_delta") / F.nullif(F.abs("total_current"), F.lit(0.0)), F.lit(0.3)), F.lit(1.0)) * 0.4
    share = lambda x: F.least(F.abs(F.coalesce(x, F.lit(0.0))) / 100, F.lit(1.0)) * 0.5
    n = lambda x: c(x).cast("string")
    return (
        card(bridge.filter(pct > 20), text("Portfolio Churn: ", n("new_count"), " new, ", n("lost_count"), " lost entities"), F.least(pct / 100, F.lit(1.0)) * 0.6)
        .unionByName(card(bridge.filter((F.abs("new_pct_of_delta") >= 30) & (c("new_count") > 0)), text("New Entities: ", n("new_count")), share(c("new_pct_of_delta"))))
        .unionByName(card(bridge.filter((c("lost_count") > 0) & (F.abs("lost_total") > 0.1 * F.abs("total_current"))), text("Lost Entities: ", n("lost_count")), share(c("lost_pct_of_delta"))))
        .unionByName(card(bridge.filter("same_store_count > 0"), text("Same-Store Organic Change: ", n("same_store_count"), " entities"), organic))
    )


def concentrations(latest: DataFrame, trend: DataFrame, movers: DataFrame) -> DataFrame:
    """latest: the row of stats.concentration; trend: of stats.concentration_trend; movers: of ranking.persistent_movers."""
    held = text("Portfolio Concentration: Top ", F.col("pareto_count").cast("string"), " of ", F.col("total_entities").cast("string"), " entities drive 80% of total")
    way = F.when(F.col("hhi_slope") > 0, "up").otherwise("down")
    often = movers.filter("persistent").agg(F.count("*").alias("n")).filter("n > 0")
    return (
        card(latest, held, F.least(F.col("gini") * 0.4, F.lit(0.5)))
        .unionByName(card(trend.filter("hhi_p_value < 0.10 AND hhi_slope <> 0"), text("Concentration: HHI trending ", way), F.least((1 - F.col("hhi_p_value")) * 0.4, F.lit(0.45))))
        .unionByName(card(often, text("Variance Driven by Same ", F.col("n").cast("string"), " Entities"), F.least(F.col("n") / 10 * 0.4, F.lit(0.4))))
    )


def cross_metrics(pairs: DataFrame, broken: DataFrame, group: str, top: int = 3) -> DataFrame:
    """pairs: a, b, r, p_value, classification, expected of metrics; broken: those of stats.compared_correlations that are."""
    known = pairs.filter("classification <> 'weak'")
    odd = known.filter("NOT expected").orderBy(F.desc(F.abs("r")), "a", "b").limit(top)
    link = known.filter("expected").orderBy(F.desc(F.abs("r")), "a", "b").limit(1)
    first = broken.orderBy(group, "a", "b").limit(1)
    return (
        card(odd, text("Unexpected Correlation: ", F.col("a"), " vs ", F.col("b")), statistical_score(p=F.col("p_value"), confidence=F.abs("r")) * 0.7)
        .unionByName(card(link, text("Operational Link: ", F.col("a"), " and ", F.col("b")), F.abs("r") * 0.5))
        .unionByName(card(first, text("Correlation Breakdown: ", F.col(group)), F.lit(0.6)))
    )


def leading_indicators(leads: DataFrame, top: int = 3) -> DataFrame:
    """leads: leader, follower, optimal_lag, lag_r, improvement."""
    best = leads.orderBy(F.desc("improvement"), "leader", "follower").limit(top)
    return card(best, text("Leading Indicator: ", F.col("leader"), " predicts ", F.col("follower")), F.abs("lag_r") * 0.8)


def variance_drivers(anova: DataFrame) -> DataFrame:
    """anova: term, eta_squared of grouped.two_way or multi_way."""
    pair, rest = F.col("term").contains(":"), F.col("term") == "residual"
    first = lambda cond: anova.filter(cond).orderBy(F.desc("eta_squared"), "term").limit(1)
    eta = F.col("eta_squared")
    return (
        card(first(~pair & ~rest), text("Primary Variance Driver: ", F.col("term")), F.least(eta * 0.8, F.lit(0.7)))
        .unionByName(card(first(pair).filter(eta >= 0.05), text("Interaction Effect: ", F.replace(F.col("term"), F.lit(":"), F.lit(" x "))), F.least(eta * 1.5, F.lit(0.6))))
        .unionByName(card(anova.filter(rest & (eta >= 0.4)), F.lit("High Unexplained Variance"), F.lit(0.4), priority=F.lit("medium")))
    )


def outlier_impacts(impact: DataFrame) -> DataFrame:
    """impact: latest_with, latest_without, slope_with, slope_without of items; the whole is their sum."""
    whole = impact.agg(*[F.sum(c).alias(c) for c in ("latest_with", "latest_without", "slope_with", "slope_without")])
    pct = (F.col("latest_with") - F.col("latest_without")) / F.nullif("latest_with", F.lit(0.0)) * 100
    bent = F.abs((F.col("slope_with") - F.col("slope_without")) / F.nullif("slope_with", F.lit(0.0)))
    return card(whole.filter(F.abs(pct) >= 3), F.lit("Outlier-Adjusted Run Rate"), F.least(F.abs(pct) / 20, F.lit(0.7))).unionByName(card(whole.filter(bent >= 0.2), F.lit("Outlier-Adjusted Trend"), F.lit(0.5), priority=F.lit("high")))


def distributions(shapes: DataFrame, latest: DataFrame) -> DataFrame:
    """shapes: of stats.distribution; latest: item, value of the last period, whose own shape is judged too."""
    count = shapes.agg(F.count("*").alias("n"), F.count_if(~F.col("is_normal")).alias("odd")).filter("n > 0 AND odd >= 0.5 * n")
    m = latest.agg(F.count("*").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")).filter("n >= 10")
    heavy = shapes.filter(F.col("classification").contains("heavy_tailed")).orderBy(F.desc("excess_kurtosis"), "item").limit(1)
    return (
        card(count, text("Non-Normal Distributions: ", F.col("odd").cast("string"), " of ", F.col("n").cast("string"), " items"), F.lit(0.4), priority=F.lit("medium"))
        .unionByName(card(m.filter((F.col("g1") ** 2 + 1) / (F.col("g2") + 3) > 0.555), F.lit("Bimodal Pattern in the latest period"), F.lit(0.6), priority=F.lit("high")))
        .unionByName(card(heavy, text("Heavy-Tailed Distribution: ", F.col("item")), F.lit(0.5), priority=F.lit("medium")))
    )


def cross_dimensions(parts: dict[str, DataFrame], entity: str, auxiliary: str) -> DataFrame:
    """parts: of variance.cross_dimension."""
    both = parts["anova"].filter((F.col("term") == f"{entity}:{auxiliary}") & (F.col("p_value") < 0.05))
    top = lambda df, n, *order: df.orderBy(*order).limit(n)
    pushes = top(parts["patterns"], 3, F.desc("consistency"), F.col("auxiliary_value"), F.col("effect_direction"))
    apart = top(parts["trends"], 2, F.desc(F.abs("slope")), F.col("item"))
    way = F.when(F.col("effect_direction") == "drag", "Drag").otherwise("Boost")
    return (
        card(both, F.lit(f"Interaction Effect: {entity} x {auxiliary}"), F.least(0.3 + F.col("eta_squared") * 2, F.lit(0.9)))
        .unionByName(card(pushes, text("Cross-Cutting ", way, ": ", F.col("auxiliary_value")), F.least(0.2 + F.abs("mean_impact_pct") / 50 + F.col("consistency") * 0.3, F.lit(0.9))))
        .unionByName(card(apart, text("Trend Divergence: ", F.col("item")), F.least(0.3 + F.col("r2") * 0.4, F.lit(0.8))))
    )
