"""Alerts: extraction, suppression, scores and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_pattern
from .ordered import first_of_each, with_totals
from .patterns import bare, texts_with_globs, texts_with_words
from .periods import at

TAGS = ("expected", "false_positive", "confirmed", "investigating")
#: The signals that an alert may carry.
SIGNALS = ("mad_outlier", "change_point", "mom_breach", "yoy_breach", "drift_detected", "seasonal_outlier", "pi_breach")


def finite(c: Column) -> Column:
    """null for NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def alert(df: DataFrame, category: str, signals: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    """Findings of one kind in the common alert schema; an alert's id is its category, item and period.

    signals: by name, the condition that sets it. weight orders alerts of one kind.
    """
    get = lambda n, t: columns.get(n, F.lit(None)).cast(t).alias(n)
    signals = signals or {}
    given = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), F.coalesce(signals.get(n, F.lit(False)), F.lit(False)).alias("value")) for n in SIGNALS]))
    out = df.select(get("period", "date"), get("item", "string"), F.lit(category).alias("category"), get("variance_amount", "double"), get("variance_pct", "double"), get("revenue", "double"), get("weight", "double"), given.alias("signals"))
    return out.withColumn("id", F.concat_ws(":", "category", F.coalesce("item", F.lit("unknown")), F.coalesce(F.col("period").cast("string"), F.lit("all"))))


def anomaly_alerts(z: DataFrame) -> DataFrame:
    """Alerts of z-score anomalies (item, period, value, avg, z_score, and the revenue they are measured by, if known)."""
    far = lambda k: F.abs("z_score") >= k
    off = F.col("value") - F.col("avg")
    return alert(z, "anomaly", {"mad_outlier": far(2.0), "change_point": far(3.0), "seasonal_outlier": far(2.0)}, period=F.col("period"), item=F.col("item"), variance_amount=off, variance_pct=F.coalesce(100 * off / F.nullif(F.abs("avg"), F.lit(0.0)), F.lit(0.0)), weight=F.abs("z_score"), **({"revenue": F.col("revenue")} if "revenue" in z.columns else {}))


def volatility_alerts(profiles: DataFrame, least: float = 0.5) -> DataFrame:
    """Alerts of items whose variation is `least` or more; they carry no signal and no amount."""
    return alert(profiles.filter(F.col("cv") >= least), "volatility", item=F.col("item"), variance_amount=F.lit(0.0), variance_pct=F.lit(0.0), weight=F.col("cv"))


def change_alerts(changes: DataFrame) -> DataFrame:
    """Alerts of change points (item, period, magnitude_dollar, magnitude_pct)."""
    return alert(changes, "structural_break", {"change_point": F.lit(True), "drift_detected": F.lit(True)}, period=F.col("period"), item=F.col("item"), variance_amount=F.col("magnitude_dollar"), variance_pct=F.col("magnitude_pct"), weight=F.abs("magnitude_dollar"))


def degradation_alerts(found: DataFrame, metric: str) -> DataFrame:
    """Alerts of kpi.degradations of a metric."""
    by = lambda k: F.abs("variance_pct") > k
    return alert(found, "degradation", {"mom_breach": by(5), "drift_detected": by(10)}, period=F.col("period"), item=F.lit(metric), variance_amount=F.abs(F.col("current") - F.col("baseline")), variance_pct=F.abs("variance_pct"), weight=F.abs("variance_pct"))


def outlier_alerts(found: DataFrame, metric: str) -> DataFrame:
    """Alerts of kpi.value_outliers of a metric."""
    far = lambda k: F.abs("z_score") >= k
    off = F.abs(F.col("value") - F.col("mean"))
    return alert(found, "outlier", {"mad_outlier": far(2.0), "change_point": far(3.0), "seasonal_outlier": far(2.0)}, period=F.col("period"), item=F.lit(metric), variance_amount=off, variance_pct=F.coalesce(100 * off / F.nullif(F.abs("mean"), F.lit(0.0)), F.lit(0.0)), weight=F.abs("z_score"))


#: How many alerts of each kind are taken.
MOST = {"anomaly": 15, "volatility": 5, "structural_break": 10, "degradation": 10, "outlier": 5}


def extracted(parts: list[DataFrame], most: dict[str, int] | None = None) -> DataFrame:
    """The weightiest alerts of each kind, in one table. Alerts of one item and period share their signals, whichever kind they are of."""
    most = MOST if most is None else most
    every = reduce(DataFrame.unionByName, parts)
    if not most:
        return merged(every)
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    limited = first_of_each(every.filter(F.col("category").isin(*most)), ("category",), max(most.values()), F.desc("weight"), F.col("id"), name="_r")
    others = every.filter(~F.coalesce(F.col("category").isin(*most), F.lit(False)))
    return merged(limited.filter(F.col("_r") <= limit[F.col("category")]).drop("_r").unionByName(others))


def merged(alerts: DataFrame) -> DataFrame:
    """alerts, each with the signals of all alerts of its item and period."""
    place = Window.partitionBy("item", "period")
    return alerts.withColumn("signals", F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), F.bool_or(F.col("signals")[n]).over(place).alias("value")) for n in SIGNALS])))


def material(df: DataFrame, blocked: tuple[str, ...] = (), least_share: float = 0.001, least_amount: float = 1000.0, ratio: bool = False, extreme: float = 500.0) -> DataFrame:
    """Alerts worth keeping: not block-listed, with enough share and amount; of ratio metrics, no extreme percentages."""
    keep = ~F.lower(F.trim("item")).isin(*[b.lower() for b in blocked]) if blocked else F.lit(True)
    keep = keep & (F.coalesce("share", F.lit(1.0)) >= least_share) & (F.abs(F.coalesce("variance_amount", F.lit(0.0))) >= (0.0 if ratio else least_amount))
    return df.filter(keep & (F.abs(F.coalesce("variance_pct", F.lit(0.0))) <= extreme) if ratio else keep)


def item_shares(df: DataFrame, item: str, value: str) -> DataFrame:
    """Each item's absolute mean over the sum of all."""
    means = df.groupBy(F.col(item).alias("item")).agg(F.abs(F.avg(F.col(value).cast("double"))).alias("m"))
    return with_totals(means, whole=F.sum("m")).select("item", (F.col("m") / F.nullif("whole", F.lit(0.0))).alias("share"))


def impact(pct: Column, share: Column, amount: Column | None = None, revenue: Column | None = None) -> Column:
    """The size of a change, weighed by how much of the whole its item is, or what it is of the revenue (10 % is all), if that is more."""
    weight = F.when(share > 0, F.least(0.1 + 3 * share, F.lit(1.0))).otherwise(0.3)
    size = F.least(F.abs(F.coalesce(pct, F.lit(0.0))) / 50, F.lit(1.0)) * (0.3 + 0.7 * weight)
    if amount is None or revenue is None:
        return size
    return F.greatest(size, F.when(revenue > 0, F.least(F.abs(F.coalesce(amount, F.lit(0.0))) / revenue * 10, F.lit(1.0))).otherwise(0.0))


def confidence(signals: Column) -> Column:
    n = F.size(F.filter(F.map_values(signals), lambda x: x))
    return F.when(n == 0, 0.0).otherwise(F.least(0.5 + 0.15 * (n - 1), F.lit(1.0)))


def persistence(periods: Column) -> Column:
    return F.when(periods <= 0, 0.0).otherwise(F.least(0.5 + 0.25 * (periods - 1), F.lit(1.0)))


def scored(df: DataFrame, weights: tuple[float, float, float] = (0.6, 0.25, 0.15), high: float = 0.6, medium: float = 0.3) -> DataFrame:
    """score from impact, confidence and persistence, and the priority that it means."""
    known = "revenue" in df.columns and "variance_amount" in df.columns
    size = impact(F.col("variance_pct"), F.col("share"), F.col("variance_amount"), F.col("revenue")) if known else impact(F.col("variance_pct"), F.col("share"))
    df = df.withColumns({"impact": size, "confidence": confidence(F.col("signals")), "persistence": persistence(F.col("periods"))})
    score = weights[0] * F.col("impact") + weights[1] * F.col("confidence") + weights[2] * F.col("persistence")
    return df.withColumn("score", score).withColumn("priority", F.when(F.col("score") >= high, "high").when(F.col("score") >= medium, "medium").otherwise("low"))


def severity(df: DataFrame) -> DataFrame:
    """One row: how grave a set of scored alerts is."""
    a = df.agg(F.max("score").alias("s"), F.count_if(F.col("priority") == "high").alias("high"), F.count_if(F.col("priority") == "medium").alias("medium"), F.count("*").alias("alerts"))
    value = F.when(F.col("high") > 0, 0.6 + 0.4 * F.col("s")).when(F.col("medium") > 0, 0.3 + 0.3 * F.col("s")).when(F.col("alerts") > 0, F.col("s")).otherwise(0.0)
    return a.select(value.alias("severity"), "high", "medium", "alerts")


RULES = "item_globs array<string>, target_globs array<string>, periods array<string>, below double"


def fits_rule(item: Column, target: Column, period: Column, score: Column) -> Column:
    """Whether a rule of the same row (RULES) fits: any of its item patterns, any of its target patterns and its periods, where it names some, and a lower score."""
    some = lambda c, x: F.exists(c, lambda g: F.rlike(x, glob_pattern(g)))
    free = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    return some("item_globs", item) & (free("target_globs") | some("target_globs", target)) & (free("periods") | F.array_contains("periods", period.cast("string"))) & (score < F.coalesce("below", F.lit(1.0)))


def fitting(rows: DataFrame, rules: DataFrame, key: tuple[str, ...], item: str, target: str, period: str, score: Column | str) -> DataFrame:
    """The distinct keys of the rows that some rule (RULES) fits; see fits_rule.

    Rules meet rows by equal items, as their patterns find them; those that take any item meet them by targets, and those that take any target
    too by periods. Only rules of nothing but wildcards are tried on all rows: of these, one for each wildcard and limit.
    """
    score = F.col(score) if isinstance(score, str) else score
    rows = rows.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col(item).alias("_item"), F.col(target).alias("_target"), F.col(period).cast("string").alias("_period"), score.alias("_score"))
    any_of = lambda c: F.coalesce(F.exists(c, bare), F.lit(False))
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    rules = rules.distinct().withColumn("_items", any_of("item_globs")).withColumn("_targets", any_of("target_globs") | none("target_globs"))
    fits = fits_rule(F.col("_item"), F.col("_target"), F.col("_period"), F.col("_score"))

    def by(some: DataFrame, globs: str, text: str) -> DataFrame:
        pairs = some.withColumn("pattern", F.explode(globs))
        found = texts_with_globs(rows.select(F.col(text).alias("text")), pairs.select("pattern"))
        return rows.join(found.join(pairs, "pattern"), (F.col(text) == F.col("text")) & fits, "left_semi")

    open_ = rules.filter("_items AND _targets")
    dated = open_.withColumn("_p", F.explode("periods"))
    rest = open_.filter(none("periods")).groupBy("item_globs", "target_globs").agg(F.first("periods").alias("periods"), F.max(F.coalesce("below", F.lit(1.0))).alias("below"))
    parts = [
        by(rules.filter("NOT _items"), "item_globs", "_item"), by(rules.filter("_items AND NOT _targets"), "target_globs", "_target"),
        rows.join(dated, (F.col("_period") == F.col("_p")) & fits, "left_semi"), rows.join(rest, fits, "left_semi"),
    ]
    return reduce(DataFrame.unionByName, parts).select(*[F.col(f"_k_{c}").alias(c) for c in key]).distinct()


def suppressed(alerts: DataFrame, rules: DataFrame, calendar: DataFrame, feedback: DataFrame) -> DataFrame:
    """alerts with why each is suppressed, or null: by a rule, else by a calendar event, else by feedback.

    rules: see RULES and fits_rule; the target is the alert's category. calendar (item, period): blank or unknown periods mean any.
    feedback (id, tag): expected or false_positive. Rules may be many; the calendar meets alerts by their items.
    Each join finds alerts' ids alone, so that an alert that several rules fit stays one row.
    """
    ids = alerts.select("id", "item", "category", "period", "score")
    rule = fitting(ids, rules, ("id",), "item", "category", "period", "score").select("id", F.lit(1).alias("why"))
    events = calendar.select(F.lower("item").alias("c_item"), F.lower(F.coalesce(F.col("period").cast("string"), F.lit(""))).alias("c_period"))
    event = ids.join(events, (F.lower("item") == F.col("c_item")) & (F.col("c_period").isin("", "unknown") | (F.col("c_period") == F.col("period").cast("string"))), "left_semi").select("id", F.lit(2).alias("why"))
    tagged = ids.join(feedback.filter(F.col("tag").isin("expected", "false_positive")), "id", "left_semi").select("id", F.lit(3).alias("why"))
    first = rule.unionByName(event).unionByName(tagged).groupBy("id").agg(F.min("why").alias("why"))
    name = F.when(F.col("why") == 1, "rule").when(F.col("why") == 2, "event").when(F.col("why") == 3, "feedback")
    return alerts.join(first, "id", "left").withColumn("suppressed_by", name).drop("why")


def valid_feedback(df: DataFrame) -> DataFrame:
    return df.withColumn("valid", F.col("tag").isin(*TAGS) & F.col("id").isNotNull())


def statistical_score(z: Column | None = None, p: Column | None = None, cv: Column | None = None, confidence: Column | None = None) -> Column:
    """The strongest of what is given: z over 5, 1 - p, variation over 2, confidence; each at most 1."""
    of = [F.least(F.abs(F.coalesce(c, F.lit(0.0))) / k, F.lit(1.0)) for c, k in ((z, 5), (cv, 2), (confidence, 1)) if c is not None]
    if p is not None:
        of.append(F.greatest(1 - F.coalesce(p, F.lit(1.0)), F.lit(0.0)))
    return F.greatest(*of, F.lit(0.0))


def magnitude_score(pct: Column) -> Column:
    return F.least(F.abs(F.coalesce(pct, F.lit(0.0))) / 50, F.lit(1.0))


def materiality_weight(share: Column) -> Column:
    """0.1, and thrice an item's share of the whole, up to 1."""
    return F.least(0.1 + 3 * F.abs(F.coalesce(share, F.lit(0.0))), F.lit(1.0))


def composite(statistical: Column, magnitude: Column, weight: Column) -> Column:
    return F.least((0.5 * statistical + 0.3 * magnitude) * (0.4 + 0.6 * weight), F.lit(1.0))


def label(score: Column) -> Column:
    return F.when(score >= 0.6, "critical").when(score >= 0.4, "high").when(score >= 0.2, "medium").otherwise("low")


def hierarchy_cards(stats: DataFrame, top: int = 5) -> DataFrame:
    """The leading cards of each level of level statistics: numbers first, then the text they make."""
    whole = stats.groupBy("level").agg(F.sum("variance_dollar").alias("_whole"))  # a row a level
    share = F.least(F.abs("variance_dollar") / F.nullif(F.abs("_whole"), F.lit(0.0)), F.lit(1.0))  # of the level's whole change
    s = stats.join(F.broadcast(whole), "level").withColumn("score", (0.3 * magnitude_score(F.col("variance_pct")) + 0.3 * F.coalesce(share, F.lit(0.0))) * (0.3 + 0.7 * materiality_weight(F.col("share_current"))))
    pct = F.abs(F.coalesce("variance_pct", F.lit(0.0)))
    s = s.withColumn("priority", F.when(pct >= 20, "critical").when(pct >= 10, "high").when(pct >= 5, "medium").otherwise("low"))
    s = first_of_each(s.drop("_whole"), ("level",), top, F.desc("score"), F.col("item"), name="card")
    return s.withColumn("title", F.format_string("Level %d variance: %s", "level", "item")).withColumn("what_changed", F.format_string("%+.0f (%+.1f%%)", "variance_dollar", F.coalesce("variance_pct", F.lit(0.0))))


def drilled_order() -> Column:
    """Grave cards first."""
    return F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)


def statistical_cards(*parts: DataFrame, top: int = 12) -> DataFrame:
    """The leading cards (title, priority, period, score, ...) of all builders: the gravest first, then recent ones, then by score."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    recent = F.coalesce(F.col("recent"), F.lit(False)) if "recent" in every.columns else F.lit(False)
    order = (drilled_order(), F.desc(recent), F.desc_nulls_last("period"), F.desc("score"), F.col("title"))
    return every.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of `top` rows


def drilled(cards: DataFrame, least: float = 0.15, deepest: int = 5) -> DataFrame:
    """Levels and whether a drill-down reaches them: each level above must have a high card or a score of 0.15."""
    per = cards.groupBy("level").agg(F.max("score").alias("best"), F.bool_or(F.col("priority").isin("critical", "high")).alias("grave"))
    goes_on = ((F.col("best") >= least) | F.col("grave") | (F.col("level") == 0)).cast("int")
    per = per.withColumn("goes_on", goes_on)
    above = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("reached", (F.coalesce(F.min("goes_on").over(above), F.lit(1)) == 1) & (F.col("level") <= deepest))


#: What signals of a source are multiplied with.
SOURCES = {"hierarchy_level_0": 1.2, "hierarchy_level_1": 1.1, "hierarchy_level_2": 1.0, "trend": 0.8, "anomaly": 0.9}


def hierarchy_signals(stats: DataFrame, metric: str, deepest: int = 2) -> DataFrame:
    """Signals (title, entity, metric, source, score) of level statistics down to a level."""
    s = stats.filter((F.col("level") <= deepest) & F.col("variance_pct").isNotNull())
    score = composite(F.lit(0.5), magnitude_score(F.col("variance_pct")), F.coalesce("share_current", F.lit(0.1)))
    return s.select(F.col("item").alias("title"), F.col("item").alias("entity"), F.lit(metric).alias("metric"), F.concat(F.lit("hierarchy_level_"), F.col("level").cast("string")).alias("source"), score.alias("score"))


def trend_signals(profiles: DataFrame, metric: str, most_p: float = 0.2, least_pct: float = 0.5) -> DataFrame:
    """Signals of items whose last three periods have a slope that is likely and not small."""
    pct = F.abs(F.col("slope_3mo") / F.nullif("avg", F.lit(0.0))) * 100
    s = profiles.withColumn("pct", pct).filter((F.col("slope_3mo_p_value") < most_p) & (F.col("pct") >= least_pct))
    score = composite(statistical_score(p=F.col("slope_3mo_p_value")), magnitude_score(F.col("pct")), F.lit(0.5))
    return s.select(F.concat("item", F.lit(f" {metric} trend")).alias("title"), F.col("item").alias("entity"), F.lit(metric).alias("metric"), F.lit("trend").alias("source"), score.alias("score"))


def anomaly_signals(z: DataFrame, metric: str, first: Column) -> DataFrame:
    """Signals of z-score anomalies (item, period, value, avg, z_score), but those of the first period."""
    pct = 100 * (F.col("value") - F.col("avg")) / F.nullif(F.abs("avg"), F.lit(0.0))
    score = composite(statistical_score(z=F.col("z_score")), magnitude_score(pct), F.lit(0.4))
    return z.filter(F.col("period") != first).select(F.concat("item", F.lit(f" {metric} anomaly")).alias("title"), F.col("item").alias("entity"), F.lit(metric).alias("metric"), F.lit("anomaly").alias("source"), score.alias("score"))


def kpi_signals(kpis: DataFrame, score: float = 0.8) -> DataFrame:
    """A signal for each KPI (name, current) that has a value."""
    return kpis.filter("current IS NOT NULL").select(F.col("name").alias("title"), F.lit("Network").alias("entity"), F.lit("derived_kpi").alias("metric"), F.lit("kpi").alias("source"), F.lit(score).alias("score"))


def cross_metric_signals(totals: DataFrame) -> DataFrame:
    """Signals of pairs of metrics (metric, pct) that move apart, or the same way at rates that are far from each other. Metrics are few."""
    a, b = totals.select(F.col("metric").alias("a"), F.col("pct").alias("x")), totals.select(F.col("metric").alias("b"), F.col("pct").alias("y"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    big, small = F.greatest(F.abs("x"), F.abs("y")), F.least(F.abs("x"), F.abs("y"))
    apart = (F.col("x") * F.col("y") < 0) & (F.abs("x") > 2) & (F.abs("y") > 2)
    ratio = big / F.greatest(small, F.lit(0.1))
    uneven = (F.col("x") * F.col("y") > 0) & (small > 3) & (ratio > 2)
    score = F.when(apart, F.least(F.abs(F.col("x") - F.col("y")) * 0.03, F.lit(1.0))).when(uneven, F.least((ratio - 2) * 0.1, F.lit(0.8)))
    title = F.when(apart, F.concat("a", F.lit(" vs "), "b")).otherwise(F.concat("a", F.lit(" and "), "b", F.lit(" rate gap")))
    return pairs.withColumn("score", score).filter("score IS NOT NULL").select(title.alias("title"), F.lit("Network").alias("entity"), F.lit("cross_metric").alias("metric"), F.lit("cross_metric").alias("source"), "score")


def cluster_signals(signals: DataFrame) -> DataFrame:
    """Signals of entities that several metrics point to."""
    c = entity_clusters(signals.withColumn("title", F.col("entity")))
    return c.select(F.concat("title", F.lit(" cluster")).alias("title"), F.col("title").alias("entity"), F.col("names").alias("metric"), F.lit("cluster").alias("source"), "score")


def ranked_signals(signals: DataFrame, top: int = 30) -> DataFrame:
    """Signals (title, metric, source, score) weighted by source, the best of each, highest first."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])[F.col("source")], F.lit(1.0))
    best = signals.withColumn("score", F.col("score") * weight).groupBy("title", "metric", "source").agg(F.max("score").alias("score"))
    order = (F.desc("score"), F.col("title"), F.col("metric"), F.col("source"))
    return best.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of `top` rows


def entity_clusters(signals: DataFrame) -> DataFrame:
    """Entities that several metrics point to: their mean score, and 0.1 for each metric more."""
    g = signals.groupBy("title").agg(F.avg("score").alias("mean"), F.count_distinct("metric").alias("metrics"), F.array_join(F.sort_array(F.collect_set("metric")), ",").alias("names"))
    return g.filter("metrics > 1").withColumn("score", F.col("mean") + 0.1 * (F.col("metrics") - 1))


def grave_metrics(findings: DataFrame) -> DataFrame:
    """(metric, has_critical_or_high) of all findings (metric, priority): cards and alerts of any kind."""
    return findings.groupBy("metric").agg(F.coalesce(F.bool_or(F.lower("priority").isin("critical", "high")), F.lit(False)).alias("has_critical_or_high"))


def material_metrics(cards: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(metric, has_material_findings): whether any level of a metric gave a card, or an anomaly (metric, priority) is grave."""
    one = cards.select("metric", F.lit(True).alias("found")).unionByName(anomalies.select("metric", F.lower("priority").isin("critical", "high").alias("found")))
    return one.groupBy("metric").agg(F.coalesce(F.bool_or("found"), F.lit(False)).alias("has_material_findings"))


def report_anomalies(entries: DataFrame, limit: int = 5) -> DataFrame:
    """The entries (id, item, z_score, deviation_pct, value) to report: labelled scenarios (a letter and up to three digits) first, then by their largest size."""
    absent = lambda c: F.abs(F.coalesce(c, F.lit(0.0)))
    sized = entries.withColumn("size", F.greatest(absent("z_score"), absent("deviation_pct") / 5, absent("value"))).withColumn("is_scenario", F.rlike("item", F.lit("^[A-Za-z][0-9]{1,3}$")))
    return sized.orderBy(F.desc("is_scenario"), F.desc("size"), "id").limit(limit)


def metric_totals(df: DataFrame, metrics: tuple[str, ...], now, then) -> DataFrame:
    """(metric, current, prior) of the whole table, a row a metric, from one pass."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), at(now, m).alias("current"), at(then, m).alias("prior")) for m in metrics])
    return df.agg(each.alias("e")).select(F.explode("e").alias("e")).select("e.*")


def in_scope(findings: DataFrame, hierarchy: DataFrame, parent: str, child: str, named: str, text: str = "item") -> DataFrame:
    """The findings whose text mentions an entity or one of its children in the hierarchy."""
    below = hierarchy.filter(F.col(parent) == named)
    words = below.select(F.col(child).alias("_word")).unionByName(below.select(F.col(parent).alias("_word"))).distinct()
    texts = texts_with_words(findings.select(F.col(text).alias("text")), words.select(F.col("_word").alias("word")))
    return findings.join(texts.withColumnRenamed("text", "_text"), F.col(text) == F.col("_text"), "left_semi")


def valid_alerts(alerts: DataFrame) -> DataFrame:
    """alerts without those of an unknown item that have no amount and no percent."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)) == 0
    known = F.coalesce(F.lower("item") != "unknown", F.lit(False))
    return alerts.filter(known | ~(zero("variance_amount") & zero("variance_pct")))


def regional_signals(stats: DataFrame, parent: str, level: int, top: int = 3) -> DataFrame:
    """By parent: the variance of its items at a level of level_statistics, and the names of those that moved most, largest first."""
    rows = stats.filter(F.col("level") == level)
    first = first_of_each(rows, (parent,), top, F.desc(F.abs("variance_dollar")), F.col("item"), name="_k")
    names = first.groupBy(F.col(parent).alias("_p")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "item"))), lambda x: x["item"]).alias("movers"))
    per = rows.groupBy(parent).agg(F.sum("variance_dollar").alias("variance"))
    return per.join(names, F.col(parent).eqNullSafe(F.col("_p")), "left").drop("_p")
