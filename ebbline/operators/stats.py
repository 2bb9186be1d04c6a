"""Statistics of items and series, in SQL expressions over aggregated rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pvalues import correlation_p, normal_p, shapiro_p
from ..sources.sinks import kept
from .ordered import numbered, quantiles
from .pairs import strong_pairs


def by_item():
    return Window.partitionBy("item")


def in_order():
    return Window.partitionBy("item").orderBy("period")


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's r over rows that have both, null where either doesn't vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def item_profiles(series: DataFrame) -> DataFrame:
    """Mean, population deviation, variation, extremes and the slope of the last three periods of each item of a dense series.

    p of a three-point slope has one degree of freedom: 1 - 2 / pi * atan(|t|).
    """
    back = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("period")))
    s = series.withColumn("back", back)
    x = F.col("period_idx").cast("double")
    recent, before = F.col("back") <= 3, (F.col("back") > 3) & (F.col("back") <= 6)
    pick = lambda f, cond: f(F.when(cond, F.col("value")), F.when(cond, x))
    out = s.groupBy("item").agg(
        F.avg("value").alias("avg"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        pick(F.regr_slope, recent).alias("slope_3mo"), pick(correlation, recent).alias("slope_3mo_r_value"), pick(F.regr_slope, before).alias("slope_before"))
    r = F.col("slope_3mo_r_value")
    t = F.abs(r) / F.sqrt(F.greatest(1 - r * r, F.lit(1e-300)))
    return out.withColumns({
        "cv": F.when(F.col("avg") != 0, F.col("std") / F.abs("avg")).otherwise(F.lit(0.0)),
        "slope_3mo_p_value": 1 - F.atan(t) * 2 / F.pi(),
        "acceleration_3mo": F.col("slope_3mo") - F.col("slope_before"),
    }).drop("slope_before")


def z_anomalies(series: DataFrame, least: float = 2.0) -> DataFrame:
    """Periods whose value lies `least` population deviations off the item's mean, with the two-sided p."""
    s = series.withColumn("avg", F.avg("value").over(by_item())).withColumn("std", F.stddev_pop("value").over(by_item()))
    hits = s.withColumn("z_score", (F.col("value") - F.col("avg")) / F.nullif("std", F.lit(0.0))).filter(F.abs("z_score") >= least)
    return hits.withColumn("p_value", normal_p("z_score"))


def correlations(wide: DataFrame, names: tuple[str, ...], *groups: str) -> DataFrame:
    """r and n of every pair of the named columns, all in one aggregation. wide has a row a period; names are few (metrics, or the leading items)."""
    one = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations(names, 2)]
    long = wide.select(*groups, F.explode(F.array(*one)).alias("p")).select(*groups, "p.*")
    return long.groupBy(*groups, "a", "b").agg(correlation("x", "y").alias("r"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"))


def item_correlations(series: DataFrame) -> DataFrame:
    """r and n of every pair of items, a before b, over the periods of a dense series: a join of the aggregated table with itself, quadratic in the items."""
    one = lambda i, v: series.select("period", F.col("item").alias(i), F.col("value").alias(v))
    pairs = one("a", "x").join(one("b", "y"), "period").filter("a < b")
    return pairs.groupBy("a", "b").agg(correlation("x", "y").alias("r"), F.count("*").alias("n"))


def uniform_growth(series: DataFrame, least: float = 0.95, share: float = 0.5) -> DataFrame:
    """One row: of all pairs of items of a dense series that vary, how many move alike, and whether these are over the share. Pairs are counted, only those that may move alike are formed."""
    known = series.filter("item IS NOT NULL AND value IS NOT NULL").groupBy("item").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("hi > lo")
    pairs = known.agg(F.count("*").alias("n")).select(F.expr("n * (n - 1) div 2").alias("pairs"))
    both = pairs.crossJoin(F.broadcast(strong_pairs(series, least).agg(F.count("*").alias("strong"))))  # a row each
    return both.select("pairs", "strong", (F.col("strong") > share * F.col("pairs")).alias("uniform"))


def leading_items(series: DataFrame, most: int) -> DataFrame:
    """The rows of the items with the largest |avg|."""
    top = series.groupBy("item").agg(F.abs(F.avg("value")).alias("size")).orderBy(F.desc("size"), "item").limit(most)
    return series.join(top.select("item"), "item", "left_semi")


def with_p(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("p_value", correlation_p("r", "n"))


def mad_outliers(series: DataFrame, threshold: float = 3.5, least: int = 6) -> DataFrame:
    """Values whose distance from the median, in scaled median absolute deviations, is over the threshold."""
    centre = series.groupBy("item").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    s = series.join(centre, "item").withColumn("deviation_from_median", F.col("value") - F.col("median"))
    mad = s.groupBy("item").agg(F.percentile(F.abs("deviation_from_median"), F.lit(0.5)).alias("mad"))
    s = s.join(mad, "item").filter((F.col("n") >= least) & (F.col("mad") != 0))
    s = s.withColumn("modified_z_score", 0.6745 * F.col("deviation_from_median") / F.col("mad")).withColumn("traditional_z_score", F.coalesce((F.col("value") - F.col("mean")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0)))
    return s.filter(F.abs("modified_z_score") > threshold).withColumn("mad_only", F.abs("traditional_z_score") <= 2)


def robust_z(totals: DataFrame, least: float = 3.0, severe: float = 5.0) -> DataFrame:
    """Periods of a total series far from its median: by the median deviation, or the deviation where that is 0."""
    t = kept(totals, "totals")
    t = t.crossJoin(F.broadcast(quantiles(t, (), "value", median=0.5)))  # a row
    off = t.select(F.abs(F.col("value") - F.col("median")).alias("off"))
    t = t.crossJoin(F.broadcast(quantiles(off, (), "off", mad=0.5))).crossJoin(F.broadcast(t.agg(F.stddev_pop("value").alias("sd"))))
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.nullif("sd", F.lit(0.0)))
    t = t.withColumn("z_score", (F.col("value") - F.col("median")) / scale).filter(F.abs("z_score") >= least)
    return t.withColumn("severity", F.when(F.abs("z_score") >= severe, "high").otherwise("medium"))


def without_outliers(series: DataFrame, method: str = "mean") -> DataFrame:
    """series with `outlier` (two deviations off the mean, or three median deviations off the median) and `clean`, the value that takes an outlier's place."""
    med = series.groupBy("item").agg(F.percentile("value", F.lit(0.5)).alias("med"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    s = series.join(med, "item").withColumn("dev", F.abs(F.col("value") - F.col("med")))
    s = s.join(s.groupBy("item").agg(F.percentile("dev", F.lit(0.5)).alias("mad")), "item")
    hit = (F.abs(F.col("value") - F.col("m")) >= 2 * F.col("sd")) & (F.col("sd") > 0) | ((F.col("dev") > 3 * F.col("mad")) & (F.col("mad") > 0))
    s = s.withColumn("outlier", hit)
    clean_mean = F.avg(F.when(~F.col("outlier"), F.col("value"))).over(by_item())
    beside = F.coalesce((F.lag("value").over(in_order()) + F.lead("value").over(in_order())) / 2, F.lag("value").over(in_order()), F.lead("value").over(in_order()))
    new = {"mean": clean_mean, "neighbours": beside, "zero": F.lit(0.0)}[method]
    return s.withColumn("clean", F.when(F.col("outlier"), new).otherwise(F.col("value"))).drop("med", "m", "sd", "dev", "mad")


def outlier_impact(series: DataFrame, method: str = "mean") -> DataFrame:
    """One row an item with outliers: mean, slope and latest value as they are and with outliers replaced."""
    x = F.col("period_idx").cast("double")
    out = without_outliers(series, method).groupBy("item").agg(
        F.count_if("outlier").alias("outliers"), F.avg("value").alias("mean_with"), F.avg("clean").alias("mean_without"), F.regr_slope("value", x).alias("slope_with"), F.regr_slope("clean", x).alias("slope_without"),
        F.max_by("value", "period").alias("latest_with"), F.max_by("clean", "period").alias("latest_without"))
    return out.filter("outliers > 0")


def leave_k_out(series: DataFrame, k: int = 5, method: str = "mean") -> DataFrame:
    """The k items whose outliers add or take away most over all periods: what the latest total would be without each one's latest outlier."""
    s = without_outliers(series, method).withColumn("impact", F.when(F.col("outlier"), F.col("value") - F.col("clean")).otherwise(0.0))
    last = F.max_by("impact", "period").alias("marginal_impact")
    per = s.groupBy("item").agg(F.sum(F.abs("impact")).alias("total_impact"), last, F.count_if("outlier").alias("outliers"), F.max_by("value", "period").alias("latest"))
    total = per.agg(F.sum("latest").alias("total"))
    top = per.filter("outliers > 0").orderBy(F.desc("total_impact"), "item").limit(k).crossJoin(F.broadcast(total))
    pct = F.coalesce(F.col("marginal_impact") / F.nullif("total", F.lit(0.0)) * 100, F.lit(0.0))
    return top.select("item", "total_impact", "marginal_impact", (F.col("total") - F.col("marginal_impact")).alias("adjusted_total"), pct.alias("marginal_impact_pct"))


def one_way_share(df: DataFrame, factor: str, value: str) -> DataFrame:
    """The part of the variation that a factor explains, from its cells' counts and sums."""
    g = df.groupBy(factor).agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("s"), F.sum(F.col(value).cast("double") * F.col(value).cast("double")).alias("ss"))
    total = g.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return total.select(F.lit(factor).alias("factor"), ((F.col("between") - mean) / F.nullif(F.col("ss") - mean, F.lit(0.0))).alias("eta_squared"))


def one_way_shares(df: DataFrame, factors: tuple[str, ...], value: str) -> DataFrame:
    """The same for several factors, from one pass over df: each row counts once for each factor."""
    v = F.col(value).cast("double")
    long = df.select(v.alias("v"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("f")).select("v", "f.*")
    g = long.groupBy("factor", "level").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    t = g.groupBy("factor").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return t.select("factor", ((F.col("between") - mean) / F.nullif(F.col("ss") - mean, F.lit(0.0))).alias("eta_squared"))


def moments(series: DataFrame) -> DataFrame:
    """Shape of each item: population skew and excess kurtosis, seven quantiles, and the coefficient of bimodality."""
    q = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
    out = series.groupBy("item").agg(F.count("*").alias("n_observations"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("excess_kurtosis"), F.percentile("value", F.array(*[F.lit(x) for x in q])).alias("q"))
    out = out.select("item", "n_observations", "skewness", "excess_kurtosis", *[F.col("q")[k].alias(f"p{round(x * 100)}") for k, x in enumerate(q)])
    b = (F.col("skewness") ** 2 + 1) / (F.col("excess_kurtosis") + 3)
    return out.withColumn("bimodality", F.when(F.col("n_observations") >= 10, b)).withColumn("is_bimodal", F.coalesce(F.col("bimodality") > 0.555, F.lit(False)))


def normality(series: DataFrame) -> DataFrame:
    """n, the joint test of skew and kurtosis, its p, and a label for each item; under eight values, or where they don't vary, there is no test.

    All follows from the count and two moments of an item, so one aggregation is enough. The statistic is the
    sum of the squared normal scores of both; it has two degrees of freedom, so p = exp(-K2 / 2).
    """
    m = series.groupBy("item").agg(F.count("value").alias("n_observations"), F.skewness("value").alias("skew"), (F.kurtosis("value") + 3).alias("kurt"))
    n = F.greatest(F.col("n_observations"), F.lit(8)).cast("double")  # the formulas divide by n - 3
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    m = m.withColumn("w2", F.sqrt(2 * (beta - 1)) - 1).withColumn("y", F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))))
    m = m.withColumn("z_skew", F.asinh(F.col("y") / F.sqrt(2 / (F.col("w2") - 1))) / F.sqrt(0.5 * F.log("w2")))
    spread = F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    m = m.withColumn("k", (F.col("kurt") - 3 * (n - 1) / (n + 1)) / spread).withColumn("root", root)
    m = m.withColumn("a", 6 + 8 / F.col("root") * (2 / F.col("root") + F.sqrt(1 + 4 / (F.col("root") * F.col("root")))))
    m = m.withColumn("ninth", 2 / (9 * F.col("a"))).withColumn("ratio", (1 - 2 / F.col("a")) / (1 + F.col("k") * F.sqrt(2 / (F.col("a") - 4))))
    m = m.withColumn("z_kurt", (1 - F.col("ninth") - F.cbrt("ratio")) / F.sqrt("ninth"))
    tested = (F.col("n_observations") >= 8) & F.col("skew").isNotNull()
    m = m.withColumn("statistic", F.when(tested, F.col("z_skew") * F.col("z_skew") + F.col("z_kurt") * F.col("z_kurt"))).withColumn("normality_p_value", F.exp(-F.col("statistic") / 2))
    is_normal = F.coalesce(F.col("normality_p_value") > 0.05, F.lit(False))
    label = F.when(F.col("statistic").isNull(), "insufficient").when(is_normal, "normal").when(F.col("skew") > 0.5, "right_skewed").when(F.col("skew") < -0.5, "left_skewed").when(F.col("kurt") > 4, "heavy_tailed").otherwise("non_normal")
    return m.select("item", "n_observations", "statistic", "normality_p_value", is_normal.alias("is_normal"), label.alias("classification"))


def distribution(series: DataFrame, top: int = 15, short: int = 50) -> DataFrame:
    """Shape of the `top` items by |avg| with eight values or more: moments, a test of normality, labels, and how far z-scores can be trusted.

    Up to `short` values are tested by Shapiro and Wilk, longer series by the joint test of skew and kurtosis.
    """
    s = leading_items(series, top)
    tests = normality(s).select("item", F.col("normality_p_value").alias("joint_p"))
    lists = s.groupBy("item").agg(F.collect_list("value").alias("values"), F.count("value").alias("n"))
    small = lists.select("item", shapiro_p(F.when(F.col("n") <= short, F.col("values"))).alias("small_p"))
    d = moments(s).filter("n_observations >= 8").join(tests, "item").join(small, "item")
    d = d.withColumn("normality_p_value", F.when(F.col("n_observations") <= short, F.col("small_p")).otherwise(F.col("joint_p")))
    skew, kurt = F.col("skewness"), F.col("excess_kurtosis")
    normal = F.coalesce((F.col("normality_p_value") > 0.05) & (F.abs(skew) < 0.5) & (F.abs(kurt) < 1), F.lit(False))
    labels = F.concat_ws(", ", F.when(skew > 0.5, "skewed_right").when(skew < -0.5, "skewed_left"), F.when(kurt > 1, "heavy_tailed").when(kurt < -1, "light_tailed"))
    label = F.when(labels != "", labels).when(normal, "normal").otherwise("near_normal")
    trust = F.when(normal, "high").when((F.abs(skew) > 1) | (F.abs(kurt) > 2), "low").otherwise("medium")
    return d.withColumns({"is_normal": normal, "classification": label, "z_score_reliability": trust}).drop("joint_p", "small_p")


def concentration(df: DataFrame, *groups: str, value: str = "value", share: float = 0.8) -> DataFrame:
    """How much a few entities hold of each group: Pareto count and ratio, top shares, HHI and Gini of absolute values.

    Entities are ordered by ranges, so that their number in a group is no limit.
    """
    r = df.withColumn("x", F.abs(F.col(value).cast("double")))
    r = numbered(r, F.desc("x"), F.col("item"), by=groups, totals={"t": "x"}, size="n", before="x")
    out = r.groupBy(*groups).agg(
        F.count("*").alias("total_entities"), F.count_if(F.col("before") < share * F.col("t")).alias("pareto_count"), F.max("t").alias("t"), F.sum(F.when(F.col("row") <= 5, F.col("x"))).alias("a"), F.sum(F.when(F.col("row") <= 10, F.col("x"))).alias("b"),
        F.sum((100 * F.col("x") / F.nullif("t", F.lit(0.0))) ** 2).alias("hhi"), F.sum((F.col("n") - F.col("row") + 1) * F.col("x")).alias("ix"))
    n = F.col("total_entities")
    out = out.withColumn("pareto_ratio", F.col("pareto_count") / n).withColumn("top_5_share", F.col("a") / F.nullif("t", F.lit(0.0))).withColumn("top_10_share", F.col("b") / F.nullif("t", F.lit(0.0)))
    label = F.when(F.col("hhi") < 1500, "competitive").when(F.col("hhi") < 2500, "moderate").otherwise("concentrated")
    return out.withColumn("hhi_label", label).withColumn("gini", 2 * F.col("ix") / F.nullif(n * F.col("t"), F.lit(0.0)) - (n + 1) / n).drop("t", "a", "b", "ix")


def concentration_trend(series: DataFrame, least: int = 6) -> DataFrame:
    """One row: the slopes of HHI and Gini over the periods, with their p; null under `least` periods."""
    x = F.col("period_idx").cast("double")
    per = concentration(series, "period", "period_idx")
    t = per.agg(F.count("*").alias("periods"), *[f.alias(n) for c in ("hhi", "gini") for n, f in ((f"{c}_slope", F.regr_slope(c, x)), (f"{c}_r", correlation(c, x)))])
    enough = F.col("periods") >= least
    t = t.select("periods", *[F.when(enough, F.col(f"{c}_{e}")).alias(f"{c}_{e}") for c in ("hhi", "gini") for e in ("slope", "r")])
    return t.withColumns({f"{c}_p_value": correlation_p(f"{c}_r", "periods") for c in ("hhi", "gini")}).drop("hhi_r", "gini_r")


def compared_correlations(population: DataFrame, entities: DataFrame, strong: float = 0.8, weak: float = 0.3, least: int = 6) -> DataFrame:
    """Pairs (a, b) of each entity that correlate strongly in the whole, and whether the entity breaks that: weak there, or of the other sign.

    population: (a, b, r, n) of the totals; entities: the same by entity, with its columns. Pairs of metrics are few.
    """
    whole = population.filter(F.abs("r") >= strong).select("a", "b", F.col("r").alias("population_r"))
    own = entities.filter((F.col("n") >= least) & F.col("r").isNotNull()).join(F.broadcast(whole), ["a", "b"])
    return own.withColumn("broken", (F.abs("r") < weak) | (F.signum("r") != F.signum("population_r")))


def lead_lag(wide: DataFrame, names: tuple[str, ...], most: int = 6, least_r: float = 0.5, gain: float = 0.1, *, least: int = 12, points: int = 6) -> DataFrame:
    """Ordered pairs whose correlation is best at a positive lag: the follower's value that many periods after the leader's.

    wide has a row a period, with period_idx. The best lag of a pair is sought from -most to most, so that a pair leads one way at most; of equal ones (to
    twelve digits), the smallest is taken. A lag with fewer than `points` pairs of values, or of values that don't vary, counts as r = 0, and under
    `least` periods there is no answer. All lags of all pairs come from one aggregation over windows of that short frame. lag_r keeps its own sign.
    """
    w = Window.orderBy("period_idx")
    frame = wide.select(*names, F.count("*").over(Window.partitionBy()).alias("_periods"), *[F.lead(n, k).over(w).alias(f"{n}__{k}") for n in names for k in range(1, most + 1)])
    later = lambda n, k: F.col(n if k == 0 else f"{n}__{k}")
    one = [F.struct(F.lit(a).alias("leader"), F.lit(b).alias("follower"), F.lit(k).alias("lag"), later(a, max(0, -k)).alias("x"), later(b, max(0, k)).alias("y")) for a in names for b in names if a != b for k in range(-most, most + 1)]
    long = frame.filter(F.col("_periods") >= least).select(F.explode(F.array(*one)).alias("p")).select("p.*")
    enough = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) >= points
    r = long.groupBy("leader", "follower", "lag").agg(F.when(enough, F.coalesce(correlation("x", "y"), F.lit(0.0))).otherwise(0.0).alias("r"))
    best = r.groupBy("leader", "follower").agg(F.max_by(F.struct("lag", "r"), F.struct(F.round(F.abs("r"), 12), -F.col("lag"))).alias("m"), F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("contemporaneous_r"))
    best = best.select("leader", "follower", F.col("m.lag").alias("optimal_lag"), F.col("m.r").alias("lag_r"), "contemporaneous_r").withColumn("improvement", F.abs("lag_r") - F.abs("contemporaneous_r"))
    return best.filter((F.col("optimal_lag") > 0) & (F.abs("lag_r") >= least_r) & (F.col("improvement") >= gain))


def seasonal(series: DataFrame, period: int = 12) -> DataFrame:
    """Trend, seasonal effect and residual of each period of series of two cycles or more: additive.

    The trend is the centred mean of a cycle, the two outermost values at half weight. The ends,
    where it doesn't reach, follow the line through the nearest cycle of trend values. The effect of
    a place in the cycle is the mean of what the trend leaves there, less the mean of all effects.
    """
    half = period // 2
    s = series.withColumn("n", F.count("*").over(by_item())).filter(F.col("n") >= 2 * period)
    inner = F.sum("value").over(in_order().rowsBetween(-half + 1, half - 1)) + (F.lag("value", half).over(in_order()) + F.lead("value", half).over(in_order())) / 2
    s = s.withColumn("mid", F.when((F.col("period_idx") > half) & (F.col("period_idx") <= F.col("n") - half), inner / period))
    x = F.col("period_idx").cast("double")
    at = lambda lo, hi: F.when((F.col("period_idx") > lo) & (F.col("period_idx") <= hi) & F.col("mid").isNotNull(), F.col("mid"))
    first, last = at(F.lit(half), F.lit(half + period)), at(F.col("n") - half - period, F.col("n") - half)
    ends = s.groupBy("item").agg(F.regr_slope(first, x).alias("b0"), F.regr_intercept(first, x).alias("a0"), F.regr_slope(last, x).alias("b1"), F.regr_intercept(last, x).alias("a1"))
    s = s.join(ends, "item").withColumn("trend", F.coalesce("mid", F.when(F.col("period_idx") <= half, F.col("a0") + F.col("b0") * x).otherwise(F.col("a1") + F.col("b1") * x)))
    phase = F.pmod(F.col("period_idx") - 1, F.lit(period))
    s = s.withColumn("phase", phase).withColumn("left", F.when(F.col("mid").isNotNull(), F.col("value") - F.col("mid")))
    effects = s.groupBy("item", "phase").agg(F.avg("left").alias("e"))
    effects = effects.withColumn("seasonal", F.col("e") - F.avg("e").over(by_item())).drop("e")
    s = s.join(effects, ["item", "phase"]).withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal"))
    return s.select("item", "period", "period_idx", "value", "trend", "seasonal", "residual")


def seasonal_summary(parts: DataFrame) -> DataFrame:
    """Residual mean and deviation, anomalies over two deviations, and seasonal strength of each item."""
    sd = F.stddev_samp("residual").over(by_item())
    p = parts.withColumn("m", F.avg("residual").over(by_item())).withColumn("sd", sd)
    out = p.groupBy("item").agg(F.avg("residual").alias("residual_mean"), F.stddev_samp("residual").alias("residual_std"), F.count_if(F.abs(F.col("residual") - F.col("m")) > 2 * F.col("sd")).alias("anomaly_count"), F.var_pop("residual").alias("vr"), F.var_pop(F.col("residual") + F.col("seasonal")).alias("vs"))
    return out.withColumn("seasonal_strength", F.greatest(F.lit(0.0), 1 - F.col("vr") / F.nullif("vs", F.lit(0.0)))).drop("vr", "vs")


def adjusted_yoy(parts: DataFrame, period: int = 12) -> DataFrame:
    """Each item's change of the last period against the one a cycle before, as it is and without the seasonal effects."""
    last = F.max("period_idx").over(by_item())
    ends = parts.withColumn("last", last).filter((F.col("period_idx") == F.col("last")) | (F.col("period_idx") == F.col("last") - period))
    at = lambda c, k: F.max(F.when(F.col("period_idx") == F.col("last") - k, c))
    clean = F.col("value") - F.col("seasonal")
    return ends.groupBy("item").agg((at(F.col("value"), 0) - at(F.col("value"), period)).alias("yoy_variance_raw"), (at(clean, 0) - at(clean, period)).alias("yoy_variance_seasonal_adjusted"))
