"""Queries of alerts and insight ranking (L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import cards, grouped, kpi, ranking
from ..operators import periods as per
from ..operators import stats as st
from ..operators import variance as var
from ..sources.sinks import kept
from .catalog import query
from .facts import SALES_SQL, complete, latest, sales, table
from .stats_queries import CHANGES, DENSE, METRICS, SEASONAL, series
from .variance_queries import STATS_SQL, monthly, resolved, stats

C = F.col
W = f"WITH {SALES_SQL}"
D = lambda c, n=None, k=6: F.round(C(c).cast("double"), k).alias(n or c)

#: Anomalies of monthly brand revenue as alerts, with the item's share, how many months it was odd, and the month's whole revenue.
ALERTS = f"""{DENSE}, z0 AS (SELECT *, avg(value) OVER (PARTITION BY item) AS m, stddev_pop(value) OVER (PARTITION BY item) AS sd, sum(value) OVER (PARTITION BY period) AS revenue FROM s), z AS (SELECT *, (value - m) / sd AS z FROM z0), sh AS (SELECT item, abs(avg(value)) / sum(abs(avg(value))) OVER () AS share FROM s GROUP BY 1),
    a0 AS (SELECT 'anomaly:' || item || ':' || CAST(period AS VARCHAR) AS id, item, period, z, value - m AS variance_amount, 100 * (value - m) / abs(m) AS variance_pct, revenue, share, count(*) OVER (PARTITION BY item) AS periods, 2 + CASE WHEN abs(z) >= 3 THEN 1 ELSE 0 END AS signals FROM z JOIN sh USING (item) WHERE abs(z) >= 2),
    a AS (SELECT *, greatest(least(abs(variance_pct) / 50, 1) * (0.3 + 0.7 * least(0.1 + 3 * share, 1)), least(abs(variance_amount) / revenue * 10, 1)) AS impact, least(0.5 + 0.15 * (signals - 1), 1) AS confidence, least(0.5 + 0.25 * (periods - 1), 1) AS persistence FROM a0), b1 AS (SELECT *, 0.6 * impact + 0.25 * confidence + 0.15 * persistence AS score FROM a),
    c AS (SELECT *, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS priority FROM b1)"""


def found(spark, sf):
    """Alerts of anomalies with all that scores need."""
    s = series(spark, sf, keep=True)
    z = st.z_anomalies(s.withColumn("revenue", F.sum("value").over(Window.partitionBy("period"))))
    out = al.anomaly_alerts(z)
    return out.join(al.item_shares(s, "item", "value"), "item").withColumn("periods", F.count("*").over(Window.partitionBy("item")))


#: Alerts of five kinds (category, item, period, pct, weight, signals as bits): brands' anomalies, variation and change points, and the monthly price's turns for the worse and outliers.
KINDS = f"""{CHANGES}, t AS (SELECT item, avg(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY 1),
    x1 AS (SELECT 'anomaly' AS category, item, period, 100 * (value - m) / abs(m) AS pct, abs((value - m) / sd) AS w, 1 + 32 + CASE WHEN abs((value - m) / sd) >= 3 THEN 2 ELSE 0 END AS bits FROM s JOIN t USING (item) WHERE abs((value - m) / sd) >= 2),
    x2 AS (SELECT 'volatility' AS category, item, CAST(NULL AS DATE) AS period, CAST(0 AS DOUBLE) AS pct, sd / abs(m) AS w, 0 AS bits FROM t WHERE sd / abs(m) >= 0.5),
    x3 AS (SELECT 'structural_break' AS category, item, period, 100 * (am - bm) / abs(bm) AS pct, abs(am - bm) AS w, 2 + 16 AS bits FROM cp),
    pr AS (SELECT period, CAST(sum(revenue) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS v FROM sales WHERE period <= (SELECT now FROM lately) GROUP BY 1), pb AS (SELECT *, avg(v) OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, lag(v, 3) OVER (ORDER BY period) AS f FROM pr),
    x4 AS (SELECT 'degradation' AS category, 'price' AS item, period, abs(100 * (v - b) / abs(b)) AS pct, abs(100 * (v - b) / abs(b)) AS w, CASE WHEN abs(100 * (v - b) / abs(b)) > 5 THEN 4 ELSE 0 END + CASE WHEN abs(100 * (v - b) / abs(b)) > 10 THEN 16 ELSE 0 END AS bits FROM pb WHERE f IS NOT NULL AND 100 * (v - b) / abs(b) < -{{worse}}),
    x5 AS (SELECT 'outlier' AS category, 'price' AS item, period, 100 * abs(v - m) / abs(m) AS pct, abs((v - m) / sd) AS w, 1 + 32 + CASE WHEN abs((v - m) / sd) >= 3 THEN 2 ELSE 0 END AS bits FROM pr, (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM pr) WHERE abs((v - m) / sd) >= 2),
    x AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3 UNION ALL SELECT * FROM x4 UNION ALL SELECT * FROM x5), y AS (SELECT *, category || ':' || item || ':' || coalesce(CAST(period AS VARCHAR), 'all') AS id FROM x),
    k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY w DESC, id) AS r FROM y), u AS (SELECT *, bit_or(bits) OVER (PARTITION BY item, period) AS all_bits FROM k WHERE r <= CASE category WHEN 'anomaly' THEN 15 WHEN 'volatility' THEN 5 WHEN 'outlier' THEN 5 ELSE 10 END)"""
#: The monthly price hardly moves; a fall of this many percent below its last three months counts here.
WORSE = 0.5


@query("l01_alert_extraction", KINDS.replace("{worse}", str(WORSE)) + " SELECT id, category, item, round(pct, 5) AS variance_pct, CAST(bit_count(all_bits) AS INTEGER) AS signals, round(CASE WHEN all_bits = 0 THEN 0 ELSE least(0.5 + 0.15 * (bit_count(all_bits) - 1), 1) END, 6) AS confidence FROM u")
def l01(spark, sf):
    """Alerts of five kinds, the weightiest of each, with the signals of all alerts of one item and month."""
    s = series(spark, sf, keep=True)
    price = kept(monthly(spark, sf, until=latest(spark, sf)[0]).select("period", (C("revenue").cast("double") / C("quantity").cast("double")).alias("price")), "price")
    parts = [
        al.anomaly_alerts(st.z_anomalies(s)), al.volatility_alerts(st.item_profiles(s)), al.change_alerts(grouped.change_points(s)),
        al.degradation_alerts(kpi.degradations(price, "price", worse=WORSE), "price"), al.outlier_alerts(kpi.value_outliers(price, "price"), "price"),
    ]
    n = F.size(F.filter(F.map_values("signals"), lambda x: x))
    return al.extracted(parts).select("id", "category", "item", D("variance_pct", k=5), n.alias("signals"), F.round(al.confidence(C("signals")), 6).alias("confidence"))


@query("l02_material_alerts", f"{ALERTS} SELECT id, round(variance_amount, 4) AS variance_amount FROM c WHERE item <> 'Brand#11' AND share >= 0.001 AND abs(variance_amount) >= 1000")
def l02(spark, sf):
    return al.material(found(spark, sf), ("brand#11",)).select("id", D("variance_amount", k=4))


@query("l03_item_shares", f"{DENSE} SELECT item, round(abs(avg(value)) / sum(abs(avg(value))) OVER (), 9) AS share FROM s GROUP BY 1")
def l03(spark, sf):
    return al.item_shares(series(spark, sf), "item", "value").select("item", D("share", k=9))


@query("l04_finite_values", "SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 5 NOT IN (0, 1)) AS finite FROM orders")
def l04(spark, sf):
    x = F.when(C("o_orderkey") % 5 == 0, F.lit(float("nan"))).when(C("o_orderkey") % 5 == 1, F.lit(float("inf"))).otherwise(C("o_totalprice"))
    return table(spark, sf, "orders").select(al.finite(x).alias("x")).agg(F.count("*").alias("rows"), F.count("x").alias("finite"))


@query("l05_impact", f"{ALERTS} SELECT id, round(impact, 6) AS impact FROM c")
def l05(spark, sf):
    return al.scored(found(spark, sf)).select("id", D("impact"))


@query("l06_confidence", f"{ALERTS} SELECT id, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM c")
def l06(spark, sf):
    return al.scored(found(spark, sf)).select("id", D("confidence"))


@query("l07_persistence", f"{ALERTS} SELECT id, round(CAST(persistence AS DOUBLE), 6) AS persistence FROM c")
def l07(spark, sf):
    return al.scored(found(spark, sf)).select("id", D("persistence"))


@query("l08_scored_alerts", f"{ALERTS} SELECT id, item, round(score, 6) AS score, priority FROM c ORDER BY c.score DESC, id LIMIT 10")
def l08(spark, sf):
    return al.scored(found(spark, sf)).orderBy(F.desc("score"), "id").limit(10).select("id", "item", D("score"), "priority")


@query("l09_severity", f"{ALERTS} SELECT round(CASE WHEN count(*) FILTER (priority = 'high') > 0 THEN 0.6 + 0.4 * max(score) WHEN count(*) FILTER (priority = 'medium') > 0 THEN 0.3 + 0.3 * max(score) ELSE coalesce(max(score), 0) END, 6) AS severity, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium, count(*) AS alerts FROM c")
def l09(spark, sf):
    return al.severity(al.scored(found(spark, sf))).select(D("severity"), "high", "medium", "alerts")


@query("l10_suppression", f"""{ALERTS}, w AS (SELECT id, CASE WHEN item LIKE 'Brand#1_' AND year(period) IN (1996, 1997) AND month(period) IN (1, 2) AND score < 0.9 THEN 'rule' WHEN item LIKE '%5' AND score < 0.2 THEN 'rule' WHEN item = 'Brand#2' OR (item = 'Brand#3' AND period = DATE '1996-01-31') THEN 'event' WHEN item = 'Brand#4' THEN 'feedback' END AS suppressed_by FROM c) SELECT coalesce(suppressed_by, 'none') AS suppressed_by, count(*) AS n FROM w GROUP BY 1""")
def l10(spark, sf):
    scored = al.scored(found(spark, sf))
    ends = ["1996-01-31", "1996-02-29", "1997-01-31", "1997-02-28"]
    rules = spark.createDataFrame([(["Brand#1?"], ["anom*", "none"], ends, 0.9), (["zzz", "*5"], [], None, 0.2)], al.RULES)
    brands = table(spark, sf, "part").select("p_brand").distinct()
    calendar = brands.filter(C("p_brand").isin("Brand#2", "Brand#3")).select(C("p_brand").alias("item"), F.when(C("p_brand") == "Brand#3", "1996-01-31").otherwise("").alias("period"))
    feedback = scored.filter(C("item") == "Brand#4").select("id", F.lit("expected").alias("tag"))
    return al.suppressed(scored, rules, calendar, feedback).groupBy(F.coalesce("suppressed_by", F.lit("none")).alias("suppressed_by")).agg(F.count("*").alias("n"))


@query("l11_feedback_tags", "SELECT t AS tag, t IN ('expected', 'false_positive', 'confirmed', 'investigating') AS valid, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'expected' WHEN 'view' THEN 'confirmed' ELSE event_type END AS t FROM events) GROUP BY 1")
def l11(spark, sf):
    tag = F.when(C("event_type") == "click", "expected").when(C("event_type") == "view", "confirmed").otherwise(C("event_type"))
    df = table(spark, sf, "events").select(C("event_id").alias("id"), tag.alias("tag"))
    return al.valid_feedback(df).groupBy("tag", "valid").agg(F.count("*").alias("n"))


@query("l12_priority_scores", f"{ALERTS}, k AS (SELECT id, (0.5 * least(abs(z) / 5, 1) + 0.3 * least(abs(variance_pct) / 50, 1)) * (0.4 + 0.6 * least(0.1 + 3 * share, 1)) AS composite FROM c) SELECT id, round(composite, 6) AS composite, CASE WHEN composite >= 0.6 THEN 'critical' WHEN composite >= 0.4 THEN 'high' WHEN composite >= 0.2 THEN 'medium' ELSE 'low' END AS label FROM k")
def l12(spark, sf):
    s = series(spark, sf, keep=True)
    z = st.z_anomalies(s).drop("p_value").join(al.item_shares(s, "item", "value"), "item")
    pct = 100 * (C("value") - C("avg")) / F.abs("avg")
    score = al.composite(al.statistical_score(C("z_score")), al.magnitude_score(pct), al.materiality_weight(C("share")))
    return z.select(F.concat(F.lit("anomaly:"), "item", F.lit(":"), C("period").cast("string")).alias("id"), score.alias("c")).select("id", D("c", "composite"), al.label(C("c")).alias("label"))


CARDS = f"""{STATS_SQL}, cs AS (SELECT *, (0.3 * least(abs(coalesce(variance_pct, 0)) / 50, 1) + 0.3 * coalesce(least(abs(variance_dollar) / nullif(abs(sum(variance_dollar) OVER (PARTITION BY level)), 0), 1), 0)) * (0.3 + 0.7 * least(0.1 + 3 * abs(coalesce(share_current, 0)), 1)) AS score, CASE WHEN abs(coalesce(variance_pct, 0)) >= 20 THEN 'critical' WHEN abs(coalesce(variance_pct, 0)) >= 10 THEN 'high' WHEN abs(coalesce(variance_pct, 0)) >= 5 THEN 'medium' ELSE 'low' END AS priority FROM st),
    cd AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, item) AS card FROM cs)"""


@query("l13_hierarchy_cards", f"{CARDS} SELECT level, item, card, round(score, 6) AS score, priority FROM cd WHERE card <= 5")
def l13(spark, sf):
    return al.hierarchy_cards(stats(spark, sf)).select("level", "item", "card", D("score"), "priority")


@query("l14_statistical_cards", f"""{SEASONAL}, zs AS (SELECT item, period, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM s WINDOW w AS (PARTITION BY item)),
    built AS (SELECT 'Anomaly: ' || item AS title, period, least(abs(z) / 5, 1) AS score FROM zs WHERE abs(z) >= 2
        UNION ALL SELECT 'Volatile: ' || item, NULL, least(CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / abs(avg(value)) ELSE 0 END, 1) FROM s GROUP BY item
        UNION ALL SELECT 'Seasonal: ' || item, NULL, greatest(0, 1 - var_pop(residual) / nullif(var_pop(loose), 0)) FROM q GROUP BY item),
    graded AS (SELECT *, CASE WHEN score >= 0.6 THEN 'critical' WHEN score >= 0.4 THEN 'high' WHEN score >= 0.2 THEN 'medium' ELSE 'low' END AS priority FROM built),
    placed AS (SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, period DESC NULLS LAST, score DESC, title) AS rank FROM graded)
    SELECT title, period, round(score, 6) AS score, priority, CAST(rank AS INTEGER) AS rank FROM placed WHERE rank <= 12""", dates="period")
def l14(spark, sf):
    """Cards of anomalies, volatile items and seasonal items, ranked together; l14_all_builders has those of all kinds."""
    s = series(spark, sf, keep=True)
    grave = lambda c: F.when(c >= 0.6, "critical").when(c >= 0.4, "high").when(c >= 0.2, "medium").otherwise("low")
    odd = st.z_anomalies(s).select(F.concat(F.lit("Anomaly: "), "item").alias("title"), "period", F.least(F.abs("z_score") / 5, F.lit(1.0)).alias("score"))
    volatile = st.item_profiles(s).select(F.concat(F.lit("Volatile: "), "item").alias("title"), F.lit(None).cast("date").alias("period"), F.least("cv", F.lit(1.0)).alias("score"))
    season = st.seasonal_summary(st.seasonal(s)).select(F.concat(F.lit("Seasonal: "), "item").alias("title"), F.lit(None).cast("date").alias("period"), C("seasonal_strength").alias("score"))
    return al.statistical_cards(*[d.withColumn("priority", grave(C("score"))) for d in (odd, volatile, season)]).select("title", "period", D("score"), "priority", "rank")


@query("l15_drill_levels", f"{CARDS}, pl AS (SELECT level, max(score) AS best, bool_or(priority IN ('critical', 'high')) AS grave FROM cd WHERE card <= 5 GROUP BY 1) SELECT level, round(best, 6) AS best, coalesce(min(CASE WHEN best >= 0.15 OR grave OR level = 0 THEN 1 ELSE 0 END) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS reached FROM pl")
def l15(spark, sf):
    return al.drilled(al.hierarchy_cards(stats(spark, sf))).select("level", D("best"), "reached")


@query("l14_all_builders")
def l14a(spark, sf):
    """The twelve leading cards of all fifteen builders."""
    return al.statistical_cards(*every_card(spark, sf).values()).select("title", "period", D("score"), "priority", "rank")


def geography(spark, sf, until):
    """Exact sums and lines per month, region, nation and segment, written once: what regions' metrics and the cells of nations and segments are rolled up from, so that line items meet customers once."""
    rows = sales(spark, sf, "region", "nation", "segment", until=until)
    return kept(rows.groupBy("period", "region", "nation", "segment").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.count("*").alias("lines")), "geography")


def every_card(spark, sf):
    """The cards of each builder, by name, over brands' monthly revenue and the monthly metrics."""
    s = series(spark, sf, keep=True)
    shares = kept(al.item_shares(s, "item", "value"), "shares")
    profiles = kept(st.item_profiles(s).join(shares, "item"), "profiles")
    months = complete(spark, sf)
    now, then = months[-1], per.prior(months, months[-1], "yoy")
    fact = geography(spark, sf, now)
    cells = kept(fact.groupBy("region", "period").agg(*[F.sum(c).cast("double").alias(c) for c in ("revenue", "quantity", "lines")]).withColumn("price", C("revenue") / F.nullif("quantity", F.lit(0.0))), "metrics")
    whole = kept(cells.groupBy("period").agg(*[F.sum(c).alias(c) for c in ("revenue", "quantity", "lines")]).withColumn("price", C("revenue") / F.nullif("quantity", F.lit(0.0))).withColumn("period_idx", F.row_number().over(Window.orderBy("period"))), "whole")
    pairs = kept(st.with_p(st.correlations(whole, METRICS)), "pairs")
    kind = F.when(F.abs("r") >= 0.8, "strong").when((F.abs("r") >= 0.5) & (C("p_value") <= 0.10), "significant").otherwise("weak")
    told = pairs.withColumn("classification", kind).withColumn("expected", ((C("a") == "revenue") & C("b").isin("quantity", "price")) | ((C("a") == "quantity") & (C("b") == "price")))
    broken = st.compared_correlations(pairs, st.correlations(cells, METRICS, "region")).filter("broken")
    parts = kept(st.seasonal(s), "seasonal")
    spread = Window.partitionBy("item")
    residuals = parts.withColumn("residual_z", (C("residual") - F.avg("residual").over(spread)) / F.nullif(F.stddev_samp("residual").over(spread), F.lit(0.0)))
    two = kept(fact.groupBy("period", "nation", "segment").agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").alias("quantity")), "cells")
    cross = var.cross_dimension(two, "nation", "segment", "revenue", now, then, months)
    return {
        "anomalies": cards.anomalies(st.z_anomalies(s).join(shares, "item"), months[-4:]), "correlations": cards.correlations(st.with_p(st.item_correlations(st.leading_items(s, 4)))),
        "trends": cards.trends(profiles), "volatility": cards.volatility(profiles), "change_points": cards.change_points(grouped.change_points(s).join(shares, "item")),
        "forecasts": cards.forecasts(grouped.holdout_forecasts(s)), "seasonal_anomalies": cards.seasonal_anomalies(residuals),
        "bridges": cards.bridges(kept(var.bridge(monthly(spark, sf, "customer", months=(now, then)), "customer", "revenue", now, then), "bridge")),
        "concentrations": cards.concentrations(st.concentration(s.filter(C("period") == now)), st.concentration_trend(s), ranking.persistent_movers(s)),
        "cross_metrics": cards.cross_metrics(told, broken, "region"), "leading_indicators": cards.leading_indicators(st.lead_lag(whole, METRICS)),
        "variance_drivers": cards.variance_drivers(kept(grouped.two_way(two, "nation", "segment", "revenue"), "anova")), "outlier_impacts": cards.outlier_impacts(st.outlier_impact(s)),
        "distributions": cards.distributions(kept(st.distribution(s), "shapes"), s.filter(C("period") == now)), "cross_dimensions": cards.cross_dimensions(cross, "nation", "segment"),
    }


_LEVELS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CASE WHEN grouping(region) = 1 THEN 0 WHEN grouping(nation) = 1 THEN 1 ELSE 2 END AS level, coalesce(nation, region, 'Total') AS item, CAST(coalesce(sum({m}) FILTER (period = (SELECT now FROM lately)), 0) AS DOUBLE) AS c, CAST(coalesce(sum({m}) FILTER (period = (SELECT year_ago FROM lately)), 0) AS DOUBLE) AS p FROM sales WHERE period IN ((SELECT now FROM lately), (SELECT year_ago FROM lately)) GROUP BY ROLLUP (region, nation)"
    for m in ("revenue", "quantity")
)
_ITEMS = " UNION ALL ".join(f"SELECT '{m}' AS metric, nation AS item, period, CAST(sum({m}) AS DOUBLE) AS v FROM sales WHERE period <= (SELECT now FROM lately) GROUP BY 2, 3" for m in ("revenue", "quantity"))
_SCORE = "least((0.5 * {} + 0.3 * least(abs({}) / 50, 1)) * (0.4 + 0.6 * {}), 1)"
SIGNALS = f"""{W}, l AS ({_LEVELS}), lv AS (SELECT *, 100 * (c - p) / nullif(abs(p), 0) AS pct, c / sum(c) OVER (PARTITION BY metric, level) AS share FROM l),
    i0 AS ({_ITEMS}), ps AS (SELECT DISTINCT period FROM i0), ip AS (SELECT period, row_number() OVER (ORDER BY period) AS k FROM ps), i AS (SELECT m.metric, m.item, ip.period, ip.k, coalesce(v, 0) AS v FROM (SELECT DISTINCT metric, item FROM i0) m CROSS JOIN ip LEFT JOIN i0 ON i0.metric = m.metric AND i0.item = m.item AND i0.period = ip.period),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric, item ORDER BY period DESC) AS back FROM i), t0 AS (SELECT metric, item, avg(v) AS a, stddev_pop(v) AS sd, regr_slope(v, k) FILTER (back <= 3) AS s3, corr(v, k) FILTER (back <= 3) AS r3 FROM r GROUP BY 1, 2), t AS (SELECT *, 1 - 2 / pi() * atan(abs(r3) / sqrt(greatest(1 - r3 * r3, 1e-300))) AS p, abs(s3 / a) * 100 AS sp FROM t0),
    n AS (SELECT metric, pct FROM lv WHERE level = 0), np AS (SELECT x.metric AS a, y.metric AS b, x.pct AS x, y.pct AS y FROM n x JOIN n y ON x.metric < y.metric),
    sg0 AS (SELECT item AS title, item AS entity, metric, 'hierarchy_level_' || level AS source, {_SCORE.format('0.5', 'pct', 'coalesce(share, 0.1)')} AS score FROM lv WHERE pct IS NOT NULL
        UNION ALL SELECT item || ' ' || metric || ' trend', item, metric, 'trend', {_SCORE.format('greatest(1 - p, 0)', 'sp', '0.5')} FROM t WHERE p < 0.2 AND sp >= 0.5
        UNION ALL SELECT i.item || ' ' || i.metric || ' anomaly', i.item, i.metric, 'anomaly', {_SCORE.format('least(abs((v - a) / sd) / 5, 1)', '100 * (v - a) / abs(a)', '0.4')} FROM i JOIN t USING (metric, item) WHERE abs((v - a) / sd) >= 2 AND i.k > 1
        UNION ALL SELECT 'price', 'Network', 'derived_kpi', 'kpi', 0.8 FROM n WHERE metric = 'revenue'
        UNION ALL SELECT CASE WHEN x * y < 0 THEN a || ' vs ' || b ELSE a || ' and ' || b || ' rate gap' END, 'Network', 'cross_metric', 'cross_metric', CASE WHEN x * y < 0 THEN least(abs(x - y) * 0.03, 1) ELSE least((greatest(abs(x), abs(y)) / greatest(least(abs(x), abs(y)), 0.1) - 2) * 0.1, 0.8) END FROM np
            WHERE (x * y < 0 AND abs(x) > 2 AND abs(y) > 2) OR (x * y > 0 AND least(abs(x), abs(y)) > 3 AND greatest(abs(x), abs(y)) / greatest(least(abs(x), abs(y)), 0.1) > 2)),
    cl AS (SELECT entity, count(DISTINCT metric) AS metrics, avg(score) + 0.1 * (count(DISTINCT metric) - 1) AS score, array_to_string(list_sort(list(DISTINCT metric)), ',') AS names FROM sg0 GROUP BY 1 HAVING count(DISTINCT metric) > 1),
    sg AS (SELECT title, metric, source, score FROM sg0 UNION ALL SELECT entity || ' cluster', names, 'cluster', score FROM cl),
    ws AS (SELECT title, metric, source, max(score * CASE source WHEN 'hierarchy_level_0' THEN 1.2 WHEN 'hierarchy_level_1' THEN 1.1 WHEN 'trend' THEN 0.8 WHEN 'anomaly' THEN 0.9 ELSE 1.0 END) AS score FROM sg GROUP BY 1, 2, 3)"""


def signals(spark, sf):
    """Signals of revenue and quantity: the geography's levels, nations' trends and anomalies, the price as KPI, and the two against each other."""
    periods = complete(spark, sf)
    now, then = periods[-1], per.prior(periods, periods[-1], "yoy")
    both = kept(monthly(spark, sf, "region", "nation", until=now), "geography")
    parts, totals = [], []
    for m in ("revenue", "quantity"):
        levels = kept(var.level_statistics(both, ("region", "nation"), m, now, then), "levels")
        s = kept(per.dense(both, "nation", m, periods), "nations")
        parts += [al.hierarchy_signals(levels, m), al.trend_signals(st.item_profiles(s), m), al.anomaly_signals(st.z_anomalies(s), m, F.lit(periods[0]))]
        totals.append(levels.filter("level = 0").select(F.lit(m).alias("metric"), C("variance_pct").alias("pct"), "current"))
    two = kept(totals[0].unionByName(totals[1]), "totals")
    price = two.agg(F.max(F.when(C("metric") == "revenue", C("current"))).alias("r"), F.max(F.when(C("metric") == "quantity", C("current"))).alias("q")).select(F.lit("price").alias("name"), (C("r") / F.nullif("q", F.lit(0.0))).alias("current"))
    out = parts[0]
    for x in [*parts[1:], al.kpi_signals(price), al.cross_metric_signals(two)]:
        out = out.unionByName(x)
    return kept(out, "signals")


@query("l16_ranked_signals", f"{SIGNALS} SELECT title, metric, source, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, title, metric, source) AS rank FROM ws QUALIFY rank <= 30")
def l16(spark, sf):
    """Signals of six sources and the clusters that they form, the best of each, thirty in all."""
    s = signals(spark, sf)
    return al.ranked_signals(s.unionByName(al.cluster_signals(s))).select("title", "metric", "source", D("score"), "rank")


@query("l17_entity_clusters", f"{SIGNALS} SELECT entity AS title, metrics, round(score, 6) AS score FROM cl")
def l17(spark, sf):
    return al.entity_clusters(signals(spark, sf).withColumn("title", C("entity"))).select("title", "metrics", D("score"))


@query("l18_network_totals", f"{W} SELECT 'revenue' AS metric, CAST(sum(revenue) FILTER (period = (SELECT now FROM lately)) AS DOUBLE) AS \"current\", CAST(sum(revenue) FILTER (period = (SELECT year_ago FROM lately)) AS DOUBLE) AS prior FROM sales UNION ALL SELECT 'quantity', CAST(sum(quantity) FILTER (period = (SELECT now FROM lately)) AS DOUBLE), CAST(sum(quantity) FILTER (period = (SELECT year_ago FROM lately)) AS DOUBLE) FROM sales")
def l18(spark, sf):
    now, then = resolved(spark, sf)
    return al.metric_totals(monthly(spark, sf, months=(now, then)), ("revenue", "quantity"), now, then)


GUARD = f"""{ALERTS}, {CARDS.removeprefix(W + ', ')}"""


@query("l19_severity_guard", f"{GUARD}, f AS (SELECT 'revenue' AS metric, priority FROM cd WHERE card <= 5 UNION ALL SELECT 'revenue anomalies', priority FROM (SELECT priority FROM c ORDER BY score DESC, id LIMIT 10)) SELECT metric, bool_or(priority IN ('critical', 'high')) AS has_critical_or_high FROM f GROUP BY 1")
def l19(spark, sf):
    """By metric: whether any card or leading alert is grave."""
    top = al.scored(found(spark, sf)).orderBy(F.desc("score"), "id").limit(10)
    rows = al.hierarchy_cards(stats(spark, sf)).select(F.lit("revenue").alias("metric"), "priority").unionByName(top.select(F.lit("revenue anomalies").alias("metric"), "priority"))
    return al.grave_metrics(rows)


@query("l20_scope_filter", f"{CARDS}, sc AS (SELECT 'ASIA' AS word UNION SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') SELECT level, item FROM cd WHERE card <= 5 AND EXISTS (SELECT 1 FROM sc WHERE contains(item, word))")
def l20(spark, sf):
    geo = table(spark, sf, "nation").join(table(spark, sf, "region"), C("n_regionkey") == C("r_regionkey"))
    return al.in_scope(al.hierarchy_cards(stats(spark, sf)), geo, "r_name", "n_name", "ASIA").select("level", "item")


@query("l21_entity_totals", f"{W} SELECT period, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS DOUBLE) AS quantity FROM sales WHERE nation = 'NATION_5' GROUP BY 1", dates="period")
def l21(spark, sf):
    return sales(spark, sf, "nation").filter(C("nation") == "NATION_5").groupBy("period").agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("double").alias("quantity"))


@query("l22_invalid_alerts", f"{ALERTS} SELECT count(*) AS valid FROM c")
def l22(spark, sf):
    f = kept(found(spark, sf).select("id", "item", "variance_amount", "variance_pct"), "alerts")
    empty = f.limit(1).select(F.lit("anomaly:unknown:all").alias("id"), F.lit("unknown").alias("item"), F.lit(0.0).alias("variance_amount"), F.lit(0.0).alias("variance_pct"))
    return al.valid_alerts(f.unionByName(empty)).agg(F.count("*").alias("valid"))


@query("l23_report_anomalies", f"{ALERTS}, k AS (SELECT id, greatest(abs(z), abs(variance_pct) / 5, abs(variance_amount) / 1e6) AS size, regexp_matches(item, '^[A-Za-z][0-9]{{1,3}}$') AS is_scenario FROM (SELECT id, CASE item WHEN 'Brand#3' THEN 'A1' ELSE item END AS item, z, variance_pct, variance_amount FROM c)) SELECT id, is_scenario, round(size, 6) AS size FROM k ORDER BY is_scenario DESC, k.size DESC, id LIMIT 5")
def l23(spark, sf):
    """Labelled scenarios (one brand stands for one here) come first; amounts count in millions."""
    z = st.z_anomalies(series(spark, sf)).drop("p_value")
    off = C("value") - C("avg")
    entries = z.select(F.concat(F.lit("anomaly:"), "item", F.lit(":"), C("period").cast("string")).alias("id"), F.when(C("item") == "Brand#3", "A1").otherwise(C("item")).alias("item"), "z_score", (100 * off / F.abs("avg")).alias("deviation_pct"), (off / 1e6).alias("value"))
    return al.report_anomalies(entries).select("id", "is_scenario", D("size"))


@query("l24_material_findings", f"{GUARD}, f AS (SELECT 'revenue' AS metric, true AS hit FROM cd WHERE card <= 5 UNION ALL SELECT 'revenue anomalies', priority IN ('critical', 'high') FROM c) SELECT metric, bool_or(hit) AS has_material_findings FROM f GROUP BY 1")
def l24(spark, sf):
    """By metric: whether a level gave a card, or an anomaly is grave."""
    shown = al.hierarchy_cards(stats(spark, sf)).select(F.lit("revenue").alias("metric"))
    return al.material_metrics(shown, al.scored(found(spark, sf)).select(F.lit("revenue anomalies").alias("metric"), "priority"))


@query("l27_regional_signals", f"{W}, {{}}".format("""v AS (SELECT region, nation, CAST(sum(CASE WHEN period = (SELECT now FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) - CAST(sum(CASE WHEN period = (SELECT year_ago FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS d FROM sales WHERE period IN ((SELECT now FROM lately), (SELECT year_ago FROM lately)) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY abs(d) DESC, nation) AS k FROM v)
    SELECT region, round(sum(d), 4) AS variance, string_agg(nation, ',' ORDER BY k) FILTER (k <= 3) AS movers FROM r GROUP BY 1"""))
def l27(spark, sf):
    out = al.regional_signals(stats(spark, sf), "region", 2)
    return out.select("region", D("variance"), F.array_join("movers", ",").alias("movers"))
