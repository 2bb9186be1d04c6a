"""Queries of period comparison and variance attribution (V)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import periods as per
from ..operators import variance as var
from .catalog import query
from .contract import SALES
from .facts import EVENTS_SQL, SALES_SQL, calendar, complete, events, latest, sales
from .ranking_queries import RUNNING, _running

C = F.col
W = f"WITH {SALES_SQL}"
D = lambda c, n=None, k=4: F.round(C(c).cast("double"), k).alias(n or c)


def monthly(spark, sf, *dims, **span):
    """Revenue and quantity per month and dimensions: what most analyses start from. span: see sales."""
    return sales(spark, sf, *dims, **span).groupBy("period", *dims).agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"))


def resolved(spark, sf):
    """The contract's latest complete period and the one a year before."""
    days = calendar(spark, sf)
    now = per.current(days, SALES.effective_lag("revenue"))
    return now, per.prior(days, now, "yoy")


LATEST = "n AS (SELECT period AS now FROM (SELECT DISTINCT period FROM sales) ORDER BY 1 DESC LIMIT 1 OFFSET 1)"


@query("v01_current_period", f"{W}, {LATEST} SELECT now AS \"current\", DATE '1999-03-31' AS asked FROM n", dates="current asked")
def v01(spark, sf):
    days = calendar(spark, sf)
    rows = sales(spark, sf, months=[per.current(days, 1), per.current(days, 0, "1999-03")]).select("period").distinct()
    return rows.agg(F.max("period").alias("current"), F.min("period").alias("asked"))


@query("v02_prior_periods", f"""{W}, {LATEST}, p AS (SELECT DISTINCT period FROM sales), k(kind, target, tol) AS (SELECT 'yoy', last_day(CAST(now - INTERVAL 12 MONTH AS DATE)), 7 FROM n UNION ALL SELECT 'qoq', last_day(CAST(now - INTERVAL 3 MONTH AS DATE)), 7 FROM n UNION ALL SELECT 'mom', last_day(CAST(now - INTERVAL 1 MONTH AS DATE)), 7 FROM n)
    SELECT kind, (SELECT period FROM p WHERE abs(period - target) <= tol ORDER BY abs(period - target) LIMIT 1) AS prior FROM k UNION ALL SELECT 'wow', max(period) FROM p, n WHERE period < now""", dates="prior")
def v02(spark, sf):
    days = calendar(spark, sf)
    now = per.current(days, 1)
    found = {k: per.prior(days, now, k) for k in ("yoy", "qoq", "mom", "wow")}
    once = sales(spark, sf, months=list(found.values())).select("period").distinct()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("prior")) for k, p in found.items()])
    return once.withColumn("k", F.explode(kinds)).filter(C("k.prior") == C("period")).select("k.kind", "k.prior")


@query("v03_comparison_switch", f"WITH {EVENTS_SQL}, d AS (SELECT DISTINCT day FROM ev), g AS (SELECT median(x) AS gap FROM (SELECT day - lag(day) OVER (ORDER BY day) AS x FROM d)) SELECT CASE WHEN gap <= 8 THEN 'wow' ELSE 'yoy' END AS kind, count(*) AS periods FROM g, d GROUP BY gap")
def v03(spark, sf):
    days = events(spark, sf).select(C("day").alias("period")).distinct()
    return days.agg(F.lit(per.comparison_kind(days)).alias("kind"), F.count("*").alias("periods"))


LEVELS = ("region", "nation")
STATS_SQL = f"""{W}, {LATEST}, b AS (SELECT CASE WHEN grouping(region) = 1 THEN 0 WHEN grouping(nation) = 1 THEN 1 ELSE 2 END AS level, coalesce(nation, region, 'Total') AS item, CAST(coalesce(sum(CASE WHEN period = now THEN revenue END), 0) AS DOUBLE) AS "current",
    CAST(coalesce(sum(CASE WHEN period = last_day(CAST(now - INTERVAL 12 MONTH AS DATE)) THEN revenue END), 0) AS DOUBLE) AS prior FROM sales, n WHERE period = now OR period = last_day(CAST(now - INTERVAL 12 MONTH AS DATE)) GROUP BY ROLLUP (region, nation)),
    v AS (SELECT *, "current" - prior AS variance_dollar, 100 * ("current" - prior) / nullif(abs(prior), 0) AS variance_pct, "current" / sum("current") OVER (PARTITION BY level) AS share_current, prior / sum(prior) OVER (PARTITION BY level) AS share_prior FROM b),
    st AS (SELECT level, item, "current", prior, variance_dollar, variance_pct, prior = 0 AND "current" <> 0 AS is_new_from_zero, share_current, share_prior, share_current - share_prior AS share_change, abs(variance_dollar) >= 50000 OR coalesce(abs(variance_pct), 0) >= 5 AS exceeds_threshold,
    row_number() OVER (PARTITION BY level ORDER BY abs(variance_dollar) DESC, item) AS rank, 100 * sum(abs(variance_dollar)) OVER (PARTITION BY level ORDER BY abs(variance_dollar) DESC, item ROWS UNBOUNDED PRECEDING) / sum(abs(variance_dollar)) OVER (PARTITION BY level) AS cumulative_pct FROM v)"""


def stats(spark, sf, lag: int = 0):
    now, then = resolved(spark, sf)
    df = monthly(spark, sf, *LEVELS, months=(now, then))
    return var.level_statistics(df, LEVELS, "revenue", now, then, lag=lag, pct=SALES.variance_pct, absolute=SALES.variance_absolute)


@query("level_stats", f"""{STATS_SQL} SELECT level, item, rank, "current", prior, round(variance_dollar, 4) AS variance_dollar, round(variance_pct, 6) AS variance_pct, is_new_from_zero, round(share_current, 9) AS share_current, round(share_prior, 9) AS share_prior, round(share_change, 9) AS share_change, exceeds_threshold, CASE WHEN exceeds_threshold THEN 'HIGH' ELSE 'LOW' END AS materiality, round(cumulative_pct, 6) AS cumulative_pct FROM st""")
def v04(spark, sf):
    """V04, the flagship: every level of the geography, latest complete month against a year before."""
    s = stats(spark, sf)
    return s.select("level", "item", "rank", "current", "prior", D("variance_dollar"), D("variance_pct", k=6), "is_new_from_zero", D("share_current", k=9), D("share_prior", k=9), D("share_change", k=9), "exceeds_threshold", "materiality", D("cumulative_pct", k=6))


@query("v05_rank_by_share", f"{STATS_SQL} SELECT level, item, row_number() OVER (PARTITION BY level ORDER BY abs(share_change) DESC, item) AS rank FROM st WHERE level > 0")
def v05(spark, sf):
    return stats(spark, sf, lag=1).filter("level > 0").select("level", "item", "rank")


@query("v06_phantom_prior", f"{W}, {LATEST} SELECT nation AS item, CAST(sum(revenue) AS DOUBLE) AS \"current\", 0.0::DOUBLE AS variance_dollar, true AS prior_missing FROM sales, n WHERE period = now GROUP BY 1")
def v06(spark, sf):
    now, _ = resolved(spark, sf)
    df = monthly(spark, sf, "nation", months=(now,))
    s = var.level_statistics(df, ("nation",), "revenue", now, dt.date(1970, 1, 31))
    return s.filter("level = 1").select("item", "current", "variance_dollar", "prior_missing")


@query("v07_quality_flags", f"{STATS_SQL} SELECT level, bool_and(coalesce(variance_pct = -100, false)) AS all_lost, bool_and(is_new_from_zero OR coalesce(variance_pct = 100, false)) AS all_new, sum(\"current\") = 0 AS empty_now FROM st GROUP BY 1")
def v07(spark, sf):
    return var.quality_flags(stats(spark, sf))


@query("v08_materiality", f"{STATS_SQL} SELECT level, count(*) FILTER (abs(variance_dollar) >= 50000) AS by_amount, count(*) FILTER (abs(variance_pct) >= 5) AS by_percent, count(*) FILTER (exceeds_threshold) AS high FROM st GROUP BY 1")
def v08(spark, sf):
    return stats(spark, sf).groupBy("level").agg(F.count_if(F.abs("variance_dollar") >= SALES.variance_absolute).alias("by_amount"), F.count_if(F.abs("variance_pct") >= SALES.variance_pct).alias("by_percent"), F.count_if("exceeds_threshold").alias("high"))


@query("v08_materiality_by_category", f"{STATS_SQL}, g AS (SELECT st.*, r_name AS category FROM st JOIN nation ON n_name = item JOIN region ON n_regionkey = r_regionkey WHERE level = 2), l AS (SELECT *, CASE category WHEN 'ASIA' THEN 40.0 WHEN 'EUROPE' THEN 10.0 ELSE 5.0 END AS p, CASE category WHEN 'ASIA' THEN 300000.0 WHEN 'EUROPE' THEN 1e9 ELSE 50000.0 END AS a FROM g) SELECT item, category, CASE WHEN abs(variance_dollar) >= a OR coalesce(abs(variance_pct), 0) >= p THEN 'HIGH' ELSE 'LOW' END AS materiality FROM l")
def v08c(spark, sf):
    """Nations by the limits of their region, or the contract's."""
    limits = {"ASIA": (40.0, 300_000.0), "EUROPE": (10.0, 1e9)}
    out = var.material_by(stats(spark, sf).filter("level = 2"), C("region"), limits, (SALES.variance_pct, SALES.variance_absolute))
    return out.select("item", C("region").alias("category"), "materiality")


@query("v10_period_over_period", f"{W}, t AS (SELECT period, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1) SELECT period, v AS total, round(v - lag(v) OVER (ORDER BY period), 4) AS change, round(100 * (v / lag(v) OVER (ORDER BY period) - 1), 6) AS change_pct FROM t", dates="period")
def v10(spark, sf):
    t = sales(spark, sf).groupBy("period").agg(F.sum("revenue").cast("double").alias("total"))
    before = F.lag("total").over(Window.orderBy("period"))
    return t.select("period", "total", F.round(C("total") - before, 4).alias("change"), F.round(100 * (C("total") / before - 1), 6).alias("change_pct"))


@query("v10_cumulative_aware", f"""{RUNNING}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY item ORDER BY period) AS s FROM u), p AS (SELECT item, count(*) AS n, max(value) - min(value) AS r, avg(CASE WHEN s > 0 THEN 1.0 WHEN s IS NOT NULL THEN 0 END) AS up, greatest(1e-6, 0.5 * quantile_cont(abs(s), 0.1)) AS t FROM d GROUP BY 1),
    q AS (SELECT d.item, avg(CASE WHEN s >= -t THEN 1.0 WHEN s IS NOT NULL THEN 0 END) AS ok FROM d JOIN p USING (item) GROUP BY 1), k AS (SELECT item, n >= 6 AND up >= 0.6 AND r > 0 AND ok >= 0.85 AS is_cumulative FROM p JOIN q USING (item)),
    e AS (SELECT u.item, period, is_cumulative, CASE WHEN is_cumulative THEN greatest(coalesce(value - lag(value) OVER (PARTITION BY u.item ORDER BY period), value), 0) ELSE value END AS v FROM u JOIN k USING (item)),
    l AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY period DESC) AS back FROM e), x AS (SELECT *, lag(v) OVER (PARTITION BY item ORDER BY period) AS b FROM l WHERE back <= 6)
    SELECT item, period, is_cumulative, round(v, 2) AS value, round(v - b, 2) AS change, round(CASE WHEN b IS NOT NULL THEN coalesce(100 * (v - b) / nullif(b, 0), 0) END, 5) AS change_pct FROM x""", dates="period")
def v10c(spark, sf):
    """Regions and their running totals, over the last six months; running totals are told and taken apart."""
    out = var.period_over_period(_running(spark, sf), last=6)
    return out.select("item", "period", "is_cumulative", D("value", k=2), D("change", k=2), D("change_pct", k=5))


DRIVERS = f"{W}, d AS (SELECT brand AS item, CAST(sum(CASE WHEN period = (SELECT now FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS c, CAST(sum(CASE WHEN period = (SELECT month_ago FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS p FROM sales WHERE period IN ((SELECT now FROM lately), (SELECT month_ago FROM lately)) GROUP BY 1)"


def _drivers(spark, sf):
    days = complete(spark, sf)
    now, before = days[-1], per.prior(days, days[-1], "mom")
    return var.delta_attribution(sales(spark, sf, "brand", months=(now, before)), "brand", "revenue", now, before)


@query("v11_delta_attribution", f"{DRIVERS} SELECT item, round(c - p, 4) AS delta, round((c - p) / sum(c - p) OVER (), 6) AS share FROM d ORDER BY abs(c - p) DESC")
def v11(spark, sf):
    return _drivers(spark, sf).orderBy(F.desc(F.abs("delta"))).select("item", D("delta"), D("share", k=6))


@query("v12_contribution_share", f"{DRIVERS} SELECT item, round((c - p) / CASE WHEN sum(c) OVER () - sum(p) OVER () = 0 THEN 1e-9 ELSE sum(c) OVER () - sum(p) OVER () END, 6) AS contribution FROM d")
def v12(spark, sf):
    return _drivers(spark, sf).select("item", D("contribution", k=6))


@query("v13_pattern_labels", f"{W}, m AS (SELECT brand AS item, period, CAST(sum(revenue) AS DOUBLE) AS v, row_number() OVER (PARTITION BY brand ORDER BY period DESC) AS r FROM sales WHERE period <= (SELECT now FROM lately) GROUP BY 1, 2) SELECT item, CASE WHEN abs(max(CASE WHEN r = 1 THEN v END) - avg(v)) > 2 * stddev_samp(v) THEN 'spike' ELSE 'run_rate_change' END AS pattern FROM m WHERE r <= 3 GROUP BY 1")
def v13(spark, sf):
    m = monthly(spark, sf, "brand", until=latest(spark, sf)[0])
    return var.pattern_labels(m.select(C("brand").alias("item"), "period", C("revenue").cast("double").alias("value")))


PVM = f"""{W}, a AS (SELECT {{}} AS item, CAST(sum(CASE WHEN period = (SELECT now FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS t1, CAST(sum(CASE WHEN period = (SELECT year_ago FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS t0, CAST(sum(CASE WHEN period = (SELECT now FROM lately) THEN quantity ELSE 0 END) AS DOUBLE) AS q1,
    CAST(sum(CASE WHEN period = (SELECT year_ago FROM lately) THEN quantity ELSE 0 END) AS DOUBLE) AS q0 FROM sales WHERE period IN ((SELECT now FROM lately), (SELECT year_ago FROM lately)) GROUP BY 1), f AS (SELECT *, coalesce(t1 / nullif(q1, 0), 0) AS p1, coalesce(t0 / nullif(q0, 0), 0) AS p0 FROM a)"""


def _two(spark, sf, *dims):
    """Sums of the last complete month and of a year before, and these two months."""
    both = latest(spark, sf)
    return monthly(spark, sf, *dims, months=both), *both


@query("v14_price_volume", PVM.format("nation") + " SELECT item, round(t1 - t0, 4) AS total_variance, round((q1 - q0) * p0, 4) AS volume_impact, round((p1 - p0) * q1, 4) AS price_impact, q1 AS curr_vol, q0 AS prior_vol, round(p1, 6) AS curr_price, round(p0, 6) AS prior_price, abs((t1 - t0) - (q1 - q0) * p0 - (p1 - p0) * q1) < 1e-3 AS adds_up FROM f")
def v14(spark, sf):
    two, now, then = _two(spark, sf, "nation")
    out = var.price_volume(two, "nation", "revenue", "quantity", now, then)
    return out.select("item", D("total_variance"), D("volume_impact"), D("price_impact"), "curr_vol", "prior_vol", D("curr_price", k=6), D("prior_price", k=6), (F.abs("residual") < 1e-3).alias("adds_up"))


@query("v15_pvm_prior", f"{W}, {LATEST}, p AS (SELECT period, row_number() OVER (ORDER BY period) AS k FROM (SELECT DISTINCT period FROM sales)) SELECT now, (SELECT period FROM p WHERE k = (SELECT k FROM p WHERE period = now) - 12) AS prior, count(*) AS lines FROM sales, n WHERE period = now GROUP BY 1", dates="now prior")
def v15(spark, sf):
    days = calendar(spark, sf)
    now = per.current(days, 1)
    return sales(spark, sf, months=(now,)).groupBy(C("period").alias("now")).agg(F.lit(per.pvm_prior(days, now)).alias("prior"), F.count("*").alias("lines"))


@query("v16_mix_shift", PVM.format("segment") + """, w AS (SELECT *, q0 / sum(q0) OVER () AS w0, q1 / sum(q1) OVER () AS w1, sum(q1) OVER () AS v1, sum(q0) OVER () AS v0, sum(t1) OVER () / sum(q1) OVER () AS b1, sum(t0) OVER () / sum(q0) OVER () AS b0, sum(t1) OVER () - sum(t0) OVER () AS tv FROM f), z AS (SELECT *, sum(w0 * p1) OVER () AS o FROM w)
    SELECT item AS segment, round(w0, 9) AS prior_weight, round(w1, 9) AS current_weight, round((w1 - w0) * p1 * v1, 3) AS contribution_to_mix_effect, round((v1 - v0) * b0, 3) AS volume_effect, round((o - b0) * v1, 3) AS price_effect, round((b1 - o) * v1, 3) AS mix_effect, round(tv, 3) AS total_variance FROM z""")
def v16(spark, sf):
    two, now, then = _two(spark, sf, "segment")
    out = var.mix_shift(two, "segment", "revenue", "quantity", now, then)
    return out.select("segment", D("prior_weight", k=9), D("current_weight", k=9), *[D(c, k=3) for c in ("contribution_to_mix_effect", "volume_effect", "price_effect", "mix_effect", "total_variance")])


@query("v17_bridge", f"""{W}, e AS (SELECT customer, CAST(sum(CASE WHEN period = (SELECT now FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS c, CAST(sum(CASE WHEN period = (SELECT year_ago FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS p, bool_or(period = (SELECT now FROM lately)) AS ic, bool_or(period = (SELECT year_ago FROM lately)) AS ip FROM sales WHERE period IN ((SELECT now FROM lately), (SELECT year_ago FROM lately)) GROUP BY 1),
    s AS (SELECT sum(c) AS tc, sum(p) AS tp, coalesce(sum(c) FILTER (NOT ip), 0) AS n, coalesce(sum(p) FILTER (NOT ic), 0) AS l, coalesce(sum(c) FILTER (ic AND ip), 0) AS sc, coalesce(sum(p) FILTER (ic AND ip), 0) AS sp, count(*) FILTER (NOT ip) AS nn, count(*) FILTER (NOT ic) AS nl, count(*) FILTER (ic AND ip) AS ns FROM e)
    SELECT round(tc, 3) AS total_current, round(tp, 3) AS total_prior, round(tc - tp, 3) AS total_delta, round(n, 3) AS new_total, round(l, 3) AS lost_total, round(sc - sp, 3) AS same_store_delta, nn AS new_count, nl AS lost_count, ns AS same_store_count, round(100 * n / (tc - tp), 6) AS new_pct_of_delta, round(-100 * l / (tc - tp), 6) AS lost_pct_of_delta, round(100 * (sc - sp) / (tc - tp), 6) AS same_store_pct_of_delta FROM s""")
def v17(spark, sf):
    two, now, then = _two(spark, sf, "customer")
    out = var.bridge(two, "customer", "revenue", now, then)
    return out.select(*[D(c, k=3) for c in ("total_current", "total_prior", "total_delta", "new_total", "lost_total", "same_store_delta")], "new_count", "lost_count", "same_store_count", *[D(c, k=6) for c in ("new_pct_of_delta", "lost_pct_of_delta", "same_store_pct_of_delta")])


@query("v17_bridge_lists", f"""{W}, e AS (SELECT customer, CAST(sum(CASE WHEN period = (SELECT now FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS c, CAST(sum(CASE WHEN period = (SELECT year_ago FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS p, bool_or(period = (SELECT now FROM lately)) AS ic, bool_or(period = (SELECT year_ago FROM lately)) AS ip FROM sales WHERE period IN ((SELECT now FROM lately), (SELECT year_ago FROM lately)) GROUP BY 1),
    b AS (SELECT customer AS entity, c AS "current", p AS prior, CASE WHEN NOT ip THEN 'new' WHEN NOT ic THEN 'lost' ELSE 'same_store' END AS bucket, CASE WHEN NOT ip THEN c WHEN NOT ic THEN p ELSE abs(c - p) END AS size FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY size DESC, entity) AS rank FROM b)
    SELECT bucket, rank, entity, round("current", 3) AS "current", round(prior, 3) AS prior, round("current" - prior, 3) AS delta, round(coalesce(100 * ("current" - prior) / nullif(prior, 0), 0), 5) AS delta_pct FROM r WHERE rank <= 5""")
def v17l(spark, sf):
    """The leading customers of each bucket; the periods follow from the calendar, the 13th-last against the last complete one."""
    now, then, _ = var.bridge_periods(complete(spark, sf), "YoY")
    out = var.bridge_lists(monthly(spark, sf, "customer", months=(now, then)), "customer", "revenue", now, then)
    return out.select("bucket", "rank", "entity", *[D(c, k=3) for c in ("current", "prior", "delta")], D("delta_pct", k=5))


CELLS = f"{W}, x AS (SELECT nation, segment, CAST(sum(CASE WHEN period = (SELECT now FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS c, CAST(sum(CASE WHEN period = (SELECT year_ago FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS p FROM sales WHERE period IN ((SELECT now FROM lately), (SELECT year_ago FROM lately)) GROUP BY 1, 2), y AS (SELECT *, 100 * (c - p) / nullif(abs(p), 0) AS pct FROM x)"


@query("v18_cross_cutting", f"""{CELLS}, k AS (SELECT segment, 'boost' AS d, avg(pct) FILTER (pct > 1) AS m, count(*) FILTER (pct > 1) AS a, array_to_string(list_sort(list(nation) FILTER (pct > 1)), ',') AS e, count(*) AS n FROM y WHERE pct IS NOT NULL GROUP BY 1 UNION ALL SELECT segment, 'drag', avg(pct) FILTER (pct < -1), count(*) FILTER (pct < -1), array_to_string(list_sort(list(nation) FILTER (pct < -1)), ','), count(*) FROM y WHERE pct IS NOT NULL GROUP BY 1)
    SELECT segment AS auxiliary_value, d AS effect_direction, round(m, 4) AS mean_impact_pct, e AS affected_entities, a AS affected_entity_count, round(a / n, 6) AS consistency, a / n >= 0.6 AS kept FROM k WHERE a / n >= 0.5 AND a >= 2""")
def v18(spark, sf):
    both, now, then = _two(spark, sf, "nation", "segment")
    two = var.cells(both, "nation", "segment", "revenue", now, then)
    out = var.cross_cutting(two, consistency=0.5)
    return out.select("auxiliary_value", "effect_direction", D("mean_impact_pct"), F.array_join("affected_entities", ",").alias("affected_entities"), "affected_entity_count", D("consistency", k=6), (C("consistency") >= 0.6).alias("kept"))


@query("v19_residual_cells", f"{W}, a AS (SELECT nation, segment, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1, 2), e AS (SELECT *, avg(v) OVER (PARTITION BY nation) + avg(v) OVER (PARTITION BY segment) - avg(v) OVER () AS x FROM a), r AS (SELECT *, v - x AS d FROM e), z AS (SELECT *, (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS z FROM r) SELECT nation AS hierarchy_entity, segment AS auxiliary_value, round(v, 3) AS actual, round(x, 3) AS expected, round(z, 6) AS residual_z FROM z WHERE abs(z) >= 2")
def v19(spark, sf):
    out = var.residual_cells(sales(spark, sf, "nation", "segment"), "nation", "segment", "revenue").filter(F.abs("residual_z") >= 2)
    return out.select("hierarchy_entity", "auxiliary_value", D("actual", k=3), D("expected", k=3), D("residual_z", k=6))


@query("v20_trend_divergence", f"""{W}, p AS (SELECT period, row_number() OVER (ORDER BY period) AS k FROM (SELECT DISTINCT period FROM sales WHERE period <= (SELECT now FROM lately))), m AS (SELECT brand AS item, period, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1, 2), d AS (SELECT b.item, p.k, coalesce(m.v, 0) AS v FROM (SELECT DISTINCT item FROM m) b CROSS JOIN p LEFT JOIN m ON m.item = b.item AND m.period = p.period),
    s AS (SELECT item, regr_slope(v, k) AS slope, regr_r2(v, k) AS r2, count(*) FILTER (v <> 0) AS n FROM d GROUP BY 1), o AS (SELECT regr_slope(v, k) AS w FROM (SELECT k, sum(v) AS v FROM d GROUP BY 1)) SELECT item, round(slope, 4) AS slope, round(r2, 9) AS r2, round(w, 3) AS overall_slope, CASE WHEN slope < 0 THEN 'declining' ELSE 'increasing' END AS direction, r2 >= 0.3 AND NOT (sign(slope) = sign(w) AND abs(slope) / abs(w) > 0.5 AND abs(slope) / abs(w) < 2) AS diverging FROM s, o WHERE n >= 3""")
def v20(spark, sf):
    """Every brand's trend beside the whole's, and which ones diverge."""
    periods = complete(spark, sf)
    out = var.trend_divergence(per.dense(monthly(spark, sf, "brand", until=periods[-1]), "brand", "revenue", periods))
    return out.select("item", D("slope"), D("r2", k=9), D("overall_slope", k=3), "direction", "diverging")


@query("v21_cross_dimension", f"{CELLS}, t AS (SELECT segment, sum(c) AS s, count(*) AS n, count(*) FILTER (pct > 1) AS up, count(*) FILTER (pct < -1) AS down FROM y GROUP BY 1 ORDER BY abs(sum(c)) DESC, 1 LIMIT 50) SELECT segment AS auxiliary_value, round(s, 3) AS current, n AS cells, up, down FROM t WHERE n >= 10")
def v21(spark, sf):
    both, now, then = _two(spark, sf, "nation", "segment")
    two = var.cells(both, "nation", "segment", "revenue", now, then)
    t = two.groupBy("auxiliary_value").agg(F.sum("current").alias("current"), F.count("*").alias("cells"), F.count_if(C("pct") > 1).alias("up"), F.count_if(C("pct") < -1).alias("down"))
    return t.orderBy(F.desc(F.abs("current")), "auxiliary_value").limit(50).filter("cells >= 10").select("auxiliary_value", D("current", k=3), "cells", "up", "down")


@query("v21_cross_dimension_summary")
def v21s(spark, sf):
    """Segments across nations over all complete months: variance shares, cells, patterns and trends, and what they come to."""
    periods = complete(spark, sf)
    now, then = periods[-1], per.prior(periods, periods[-1], "yoy")
    df = monthly(spark, sf, "nation", "segment", until=now).withColumn("revenue", C("revenue").cast("double"))
    return var.cross_dimension(df, "nation", "segment", "revenue", now, then, periods)["summary"]


TOTALS = f"{W}, g AS (SELECT region, 100 * (CAST(sum(revenue) FILTER (period = (SELECT now FROM lately)) AS DOUBLE) / CAST(sum(revenue) FILTER (period = (SELECT year_ago FROM lately)) AS DOUBLE) - 1) AS rev, 100 * (CAST(sum(quantity) FILTER (period = (SELECT now FROM lately)) AS DOUBLE) / CAST(sum(quantity) FILTER (period = (SELECT year_ago FROM lately)) AS DOUBLE) - 1) AS vol FROM sales WHERE period IN ((SELECT now FROM lately), (SELECT year_ago FROM lately)) GROUP BY 1)"


def _growth(spark, sf):
    two, now, then = _two(spark, sf, "region")
    return var.growth(two, "region", now, then, rev="revenue", vol="quantity")


@query("v22_metric_divergence", f"{TOTALS} SELECT region, round(rev, 6) AS rev, round(vol, 6) AS vol, rev * vol < 0 AND abs(rev) > 2 AND abs(vol) > 2 AS diverges, greatest(abs(rev), abs(vol)) > 2 * least(abs(rev), abs(vol)) AND abs(rev) > 3 AND abs(vol) > 3 AS rate_mismatch FROM g")
def v22(spark, sf):
    out = var.metric_divergence(_growth(spark, sf), "rev", "vol")
    return out.select("region", D("rev", k=6), D("vol", k=6), "diverges", "rate_mismatch")


@query("v23_price_yield_split", f"{TOTALS} SELECT region, round(rev - vol, 6) AS price_pct, CASE WHEN vol >= 0 AND rev - vol >= 0 THEN 'volume and price up' WHEN vol >= 0 THEN 'volume up, price down' WHEN rev - vol >= 0 THEN 'price up, volume down' ELSE 'volume and price down' END AS label FROM g")
def v23(spark, sf):
    return var.price_yield(_growth(spark, sf), "rev", "vol").select("region", D("price_pct", k=6), "label")


@query("v24_high_low", f"{W}, m AS (SELECT brand, period, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE period <= (SELECT now FROM lately) GROUP BY 1, 2), x AS (SELECT *, max(v) OVER (PARTITION BY brand) AS hi, min(v) OVER (PARTITION BY brand) AS lo FROM m) SELECT brand, v >= 0.9 * hi AS near_high, v <= 1.5 * lo AS near_low FROM x WHERE period = (SELECT now FROM lately)")
def v24(spark, sf):
    now, _ = latest(spark, sf)
    m = monthly(spark, sf, "brand", until=now).select(C("brand").alias("item"), "period", C("revenue").cast("double").alias("value"))
    return var.near_extremes(m, now).withColumnRenamed("item", "brand")


@query("v25_top3_risk", f"{W}, t AS (SELECT region, nation, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY v DESC, nation) AS r FROM t) SELECT region, round(sum(v) FILTER (r <= 3) / sum(v), 9) AS top3, sum(v) FILTER (r <= 3) / sum(v) > 0.6 AS at_risk FROM r GROUP BY 1")
def v25(spark, sf):
    out = var.top_share_risk(sales(spark, sf, "region", "nation"), "region", "nation", "revenue")
    return out.select("region", D("top_share", "top3", 9), "at_risk")


@query("v26_displayed_cumulative", f"{STATS_SQL} SELECT item, round(100 * sum(abs(variance_dollar)) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(abs(variance_dollar)) OVER (), 6) AS shown_cumulative_pct FROM st WHERE level = 2 AND rank <= 10")
def v26(spark, sf):
    return var.displayed_cumulative(stats(spark, sf).filter("level = 2")).select("item", D("shown_cumulative_pct", k=6))


@query("v27_event_window", f"WITH {EVENTS_SQL}, d AS (SELECT metric, day, CAST(sum(value) AS DOUBLE) AS v FROM ev WHERE isodow(day) <= 5 GROUP BY 1, 2) SELECT metric, round(avg(v) FILTER (day BETWEEN DATE '2024-01-22' AND DATE '2024-01-26') / avg(v) FILTER (day BETWEEN DATE '2024-01-01' AND DATE '2024-01-19'), 6) AS ratio FROM d GROUP BY 1")
def v27(spark, sf):
    d = events(spark, sf).groupBy("metric", "day").agg(F.sum("value").cast("double").alias("v"))
    return var.event_ratio(d, "metric", "v", ("2024-01-22", "2024-01-26"), ("2024-01-01", "2024-01-19")).select("metric", D("ratio", k=6))


@query("v28_yearly_truth", f"{W}, g AS (SELECT region, CAST(sum(revenue) FILTER (year(order_date) = 2000) AS DOUBLE) AS c, CAST(sum(revenue) FILTER (year(order_date) = 1999) AS DOUBLE) AS p FROM sales GROUP BY ROLLUP (region)) SELECT coalesce(region, 'Total') AS item, round(100 * (c / p - 1), 6) AS yoy_pct, row_number() OVER (PARTITION BY region IS NULL ORDER BY c - p DESC) AS rank FROM g")
def v28(spark, sf):
    df = sales(spark, sf, "region", since=dt.date(1999, 1, 1), until=dt.date(2000, 12, 31))
    return var.yearly_truth(df, "region", "order_date", "revenue", 2000).select("item", D("yoy_pct", k=6), "rank")


@query("v28_scenario_deviation", f"{W}, r AS (SELECT region, segment, CASE flag WHEN 'R' THEN 'returned' END AS scenario, CAST(revenue AS DOUBLE) AS v FROM sales), b AS (SELECT region, segment, avg(v) AS b FROM r WHERE scenario IS NULL GROUP BY 1, 2), h AS (SELECT scenario, region, segment, avg(v) AS a, count(*) AS rows FROM r WHERE scenario IS NOT NULL GROUP BY 1, 2, 3) SELECT scenario, region, segment, rows, round(a, 4) AS scenario_avg, round(b, 4) AS baseline_avg, round(100 * (a - b) / b, 5) AS deviation_pct FROM h LEFT JOIN b USING (region, segment)")
def v28d(spark, sf):
    """Returned lines as a labelled scenario, against the unlabelled lines of the same region and segment."""
    df = sales(spark, sf, "region", "segment", "flag").withColumn("scenario", F.when(C("flag") == "R", "returned"))
    out = var.scenario_deviation(df, "scenario", ("region", "segment"), "revenue")
    return out.select("scenario", "region", "segment", "rows", D("scenario_avg"), D("baseline_avg"), D("deviation_pct", k=5))
