"""Queries of statistical analytics (T)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grouped
from ..operators import periods as per
from ..operators import stats as st
from ..operators.pairs import strongest_pairs
from ..operators.smoothing import fitted_forecasts
from ..sources.sinks import kept
from .catalog import query
from .facts import EVENTS_SQL, SALES_SQL, complete, events, latest, sales
from .variance_queries import monthly

C = F.col
W = f"WITH {SALES_SQL}"
D = lambda c, n=None, k=4: F.round(C(c).cast("double"), k).alias(n or c)


def series(spark, sf, dim="brand", value="revenue", keep=False):
    """Complete months of each item, 0 where it has none. keep: written once, for queries that use it several times."""
    periods = complete(spark, sf)
    out = per.dense(monthly(spark, sf, dim, until=periods[-1]), dim, value, periods)
    return kept(out, "series") if keep else out


DENSE = f"""{W}, p AS (SELECT period, CAST(row_number() OVER (ORDER BY period) AS INTEGER) AS period_idx FROM (SELECT DISTINCT period FROM sales WHERE period <= (SELECT now FROM lately))), m0 AS (SELECT brand AS item, period, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1, 2),
    s AS (SELECT b.item, p.period, p.period_idx, coalesce(m0.v, 0) AS value FROM (SELECT DISTINCT item FROM m0) b CROSS JOIN p LEFT JOIN m0 ON m0.item = b.item AND m0.period = p.period)"""

PROFILE = f"""{DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY period DESC) AS k FROM s), t AS (SELECT item, avg(value) AS a, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi, regr_slope(value, period_idx) FILTER (k <= 3) AS s3, corr(value, period_idx) FILTER (k <= 3) AS r3, regr_slope(value, period_idx) FILTER (k > 3 AND k <= 6) AS s6 FROM r GROUP BY 1)"""


@query("t01_item_profiles", f"{PROFILE} SELECT item, round(a, 4) AS avg, round(sd, 4) AS std, round(sd / abs(a), 6) AS cv, round(s3, 3) AS slope_3mo, round(r3, 6) AS slope_3mo_r_value, round(1 - 2 / pi() * atan(abs(r3) / sqrt(greatest(1 - r3 * r3, 1e-300))), 5) AS slope_3mo_p_value, round(s3 - s6, 3) AS acceleration_3mo, round(lo, 4) AS min, round(hi, 4) AS max FROM t")
def t01(spark, sf):
    out = st.item_profiles(series(spark, sf))
    return out.select("item", D("avg"), D("std"), D("cv", k=6), D("slope_3mo", k=3), D("slope_3mo_r_value", k=6), D("slope_3mo_p_value", k=5), D("acceleration_3mo", k=3), D("min"), D("max"))


@query("t02_top_items", f"{PROFILE}, a AS (SELECT 'driver' AS kind, item, round(abs(a), 4) AS size FROM t ORDER BY abs(a) DESC, item LIMIT 10), b AS (SELECT 'volatile' AS kind, item, round(sd / abs(a), 4) AS size FROM t ORDER BY sd / abs(a) DESC, item LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b")
def t02(spark, sf):
    out = kept(st.item_profiles(series(spark, sf)), "profiles")
    top = lambda kind, by: out.orderBy(F.desc(by), "item").limit(10).select(F.lit(kind).alias("kind"), "item", F.round(by, 4).alias("size"))
    return top("driver", F.abs("avg")).unionByName(top("volatile", C("cv")))


@query("t03_z_anomalies", f"{DENSE}, z AS (SELECT *, (value - avg(value) OVER (PARTITION BY item)) / stddev_pop(value) OVER (PARTITION BY item) AS z FROM s) SELECT item, period, round(value, 4) AS value, round(z, 6) AS z_score FROM z WHERE abs(z) >= 2 ORDER BY period DESC, abs(z) DESC, item LIMIT 20", dates="period")
def t03(spark, sf):
    out = st.z_anomalies(series(spark, sf))
    return out.orderBy(F.desc("period"), F.desc(F.abs("z_score")), "item").limit(20).select("item", "period", D("value"), D("z_score", k=6))


#: Two-sided p of a standard normal z: 1 - erf, as a series of positive terms.
NORMAL_P = "1 - list_sum(list_transform(range(0, 200), lambda k: exp(-z * z / 2 + (2 * k + 1) * ln(abs(z) / sqrt(2)) - lgamma(k + 1.5))))"
#: Two-sided p of a correlation r of n points: the finite sums of Student's t for even and for odd degrees of freedom.
_REST = "ln(greatest(1 - r * r, 1e-300))"
_EVEN = f"1 - abs(r) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2 + k * {_REST})))"
_ODD = f"1 - 2 / pi() * (asin(abs(r)) + abs(r) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: exp(ln(pi()) / 2 - ln(2) + lgamma(k + 1) - lgamma(k + 1.5) + (k + 0.5) * {_REST}))), 0))"
CORRELATION_P = f"CASE WHEN n % 2 = 0 THEN {_EVEN} ELSE {_ODD} END"


@query("t03_p_values", f"{DENSE}, z AS (SELECT *, (value - avg(value) OVER (PARTITION BY item)) / stddev_pop(value) OVER (PARTITION BY item) AS z FROM s) SELECT item, period, round(z, 6) AS z_score, round({NORMAL_P}, 9) AS p_value FROM z WHERE abs(z) >= 2", dates="period")
def t03p(spark, sf):
    """All anomalies with their two-sided p."""
    return st.z_anomalies(series(spark, sf)).select("item", "period", D("z_score", k=6), D("p_value", k=9))


def _leading(spark, sf):
    """The six items with the largest |avg|."""
    return st.leading_items(series(spark, sf, keep=True), 6)


PAIRS = f"{DENSE}, lead AS (SELECT item FROM s GROUP BY 1 ORDER BY abs(avg(value)) DESC, item LIMIT 6), q AS (SELECT * FROM s WHERE item IN (SELECT item FROM lead)), c AS (SELECT x.item AS a, y.item AS b, corr(x.value, y.value) AS r, count(*) AS n FROM q x JOIN q y ON x.period = y.period AND x.item < y.item GROUP BY 1, 2)"


@query("t04_uniform_growth", f"{PAIRS} SELECT count(*) AS pairs, count(*) FILTER (abs(r) >= 0.95) AS strong, count(*) FILTER (abs(r) >= 0.95) > 0.5 * count(*) AS uniform FROM c WHERE isfinite(r)")
def t04(spark, sf):
    """Over the pairs of the six leading items; t04_uniform_growth_all is over those of all items."""
    return st.uniform_growth(_leading(spark, sf))


@query("t05_item_correlations", f"{PAIRS} SELECT a, b, round(r, 6) AS r, n FROM c")
def t05(spark, sf):
    return st.item_correlations(_leading(spark, sf)).select("a", "b", D("r", k=6), "n")


EVERY_PAIR = f"{DENSE}, c AS (SELECT x.item AS a, y.item AS b, corr(x.value, y.value) AS r, count(*) AS n FROM s x JOIN s y ON x.period = y.period AND x.item < y.item GROUP BY 1, 2)"


@query("t04_uniform_growth_all", f"{EVERY_PAIR} SELECT count(*) AS pairs, count(*) FILTER (abs(r) >= 0.95) AS strong, count(*) FILTER (abs(r) >= 0.95) > 0.5 * count(*) AS uniform FROM c WHERE isfinite(r)")
def t04a(spark, sf):
    """Over the pairs of all items."""
    return st.uniform_growth(series(spark, sf, keep=True))


@query("t05_all_item_correlations", f"{EVERY_PAIR} SELECT a, b, round(r, 6) AS r, n FROM c")
def t05a(spark, sf):
    return st.item_correlations(series(spark, sf, keep=True)).select("a", "b", D("r", k=6), "n")


@query("t05_key_correlations", f"{EVERY_PAIR}, k AS (SELECT *, {CORRELATION_P} AS p FROM c) SELECT a, b, round(r, 6) AS r, n, round(p, 6) AS p_value, abs(r) > 0.7 AND p < 0.05 AS kept FROM k ORDER BY abs(r) DESC, a, b LIMIT 6")
def t05p(spark, sf):
    """The six strongest pairs of all items, and which are strong and significant."""
    return st.with_p(strongest_pairs(series(spark, sf), 6)).select("a", "b", D("r", k=6), "n", D("p_value", k=6), ((F.abs("r") > 0.7) & (C("p_value") < 0.05)).alias("kept"))


@query("t05_leading_correlations", f"{EVERY_PAIR}, lead AS (SELECT item FROM s GROUP BY 1 ORDER BY abs(avg(value)) DESC, item LIMIT 4), k AS (SELECT *, {CORRELATION_P} AS p FROM c WHERE a IN (SELECT item FROM lead) AND b IN (SELECT item FROM lead)) SELECT a, b, round(r, 6) AS r, n, round(p, 6) AS p_value, abs(r) > 0.7 AND p < 0.05 AS kept FROM k")
def t05l(spark, sf):
    """The six pairs of the four items with the largest |avg|, and which are strong and significant."""
    pairs = st.with_p(st.item_correlations(st.leading_items(series(spark, sf, keep=True), 4)))
    return pairs.select("a", "b", D("r", k=6), "n", D("p_value", k=6), ((F.abs("r") > 0.7) & (C("p_value") < 0.05)).alias("kept"))


@query("t06_mad_outliers", f"""{DENSE}, c AS (SELECT item, median(value) AS med, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM s GROUP BY 1), d AS (SELECT s.item, median(abs(value - med)) AS mad FROM s JOIN c USING (item) GROUP BY 1),
    z AS (SELECT s.item, period, value, med, 0.6745 * (value - med) / mad AS z, (value - m) / sd AS tz FROM s JOIN c USING (item) JOIN d USING (item) WHERE mad <> 0 AND n >= 6) SELECT item, period, round(value, 4) AS amount, round(med, 4) AS median, round(z, 6) AS modified_z_score, round(tz, 6) AS traditional_z_score, abs(tz) <= 2 AS mad_only, round(value - med, 4) AS deviation_from_median, abs(z) > 3.5 AS is_outlier FROM z WHERE abs(z) > 2.5""", dates="period")
def t06(spark, sf):
    """Values over 2.5 scaled deviations off, and which are outliers by the rule's 3.5."""
    out = st.mad_outliers(series(spark, sf, keep=True), 2.5)
    return out.select("item", "period", D("value", "amount"), D("median"), D("modified_z_score", k=6), D("traditional_z_score", k=6), "mad_only", D("deviation_from_median"), (F.abs("modified_z_score") > 3.5).alias("is_outlier"))


@query("t07_robust_z", f"WITH {EVENTS_SQL}, t AS (SELECT day AS period, CAST(sum(value) AS DOUBLE) AS v FROM ev GROUP BY 1), m AS (SELECT median(v) AS med FROM t), d AS (SELECT median(abs(v - med)) AS mad FROM t, m), z AS (SELECT period, v, (v - med) / (1.4826 * mad) AS z FROM t, m, d) SELECT period, round(v, 4) AS value, round(z, 6) AS z_score, CASE WHEN abs(z) >= 5 THEN 'high' ELSE 'medium' END AS severity, abs(z) >= 3 AS is_anomaly FROM z WHERE abs(z) >= 1", dates="period")
def t07(spark, sf):
    t = events(spark, sf).groupBy(C("day").alias("period")).agg(F.sum("value").cast("double").alias("value"))
    return st.robust_z(t, 1.0).select("period", D("value"), D("z_score", k=6), "severity", (F.abs("z_score") >= 3).alias("is_anomaly"))


@query("t08_outlier_impact", f"""{DENSE}, c AS (SELECT *, median(value) OVER (PARTITION BY item) AS med, avg(value) OVER (PARTITION BY item) AS m, stddev_pop(value) OVER (PARTITION BY item) AS sd FROM s), d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY item) AS mad FROM c), o AS (SELECT *, (abs(value - m) >= 2 * sd AND sd > 0) OR (abs(value - med) > 3 * mad AND mad > 0) AS hit FROM d),
    k AS (SELECT *, CASE WHEN hit THEN avg(CASE WHEN NOT hit THEN value END) OVER (PARTITION BY item) ELSE value END AS clean FROM o) SELECT item, count(*) FILTER (hit) AS outliers, round(avg(value), 4) AS mean_with, round(avg(clean), 4) AS mean_without, round(regr_slope(value, period_idx), 3) AS slope_with, round(regr_slope(clean, period_idx), 3) AS slope_without FROM k GROUP BY 1 HAVING count(*) FILTER (hit) > 0""")
def t08(spark, sf):
    out = st.outlier_impact(series(spark, sf, keep=True))
    return out.select("item", "outliers", D("mean_with"), D("mean_without"), D("slope_with", k=3), D("slope_without", k=3))


@query("t08_leave_k_out", f"""{DENSE}, c AS (SELECT *, median(value) OVER (PARTITION BY item) AS med, avg(value) OVER (PARTITION BY item) AS m, stddev_pop(value) OVER (PARTITION BY item) AS sd FROM s), d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY item) AS mad FROM c), o AS (SELECT *, (abs(value - m) >= 2 * sd AND sd > 0) OR (abs(value - med) > 3 * mad AND mad > 0) AS hit FROM d),
    k AS (SELECT *, CASE WHEN hit THEN value - avg(CASE WHEN NOT hit THEN value END) OVER (PARTITION BY item) ELSE 0 END AS impact FROM o), i AS (SELECT item, sum(abs(impact)) AS total_impact, arg_max(impact, period) AS marginal, count(*) FILTER (hit) AS outliers FROM k GROUP BY 1), t AS (SELECT sum(value) AS total FROM s WHERE period = (SELECT now FROM lately))
    SELECT item, round(total_impact, 3) AS total_impact, round(marginal, 3) AS marginal_impact, round(total - marginal, 3) AS adjusted_total, round(100 * marginal / total, 6) AS marginal_impact_pct FROM i, t WHERE outliers > 0 ORDER BY i.total_impact DESC, item LIMIT 5""")
def t08k(spark, sf):
    """The five brands whose outliers matter most, each left out in turn."""
    return st.leave_k_out(series(spark, sf, keep=True)).select("item", *[D(c, k=3) for c in ("total_impact", "marginal_impact", "adjusted_total")], D("marginal_impact_pct", k=6))


@query("t09_variance_decomposition", f"{W}, g AS (SELECT avg(CAST(revenue AS DOUBLE)) AS m, sum((CAST(revenue AS DOUBLE)) ^ 2) AS ss, count(*) AS n FROM sales), f AS (SELECT 'region' AS factor, sum(c * (a - m) ^ 2) AS b FROM (SELECT region, avg(CAST(revenue AS DOUBLE)) AS a, count(*) AS c FROM sales GROUP BY 1), g UNION ALL SELECT 'brand', sum(c * (a - m) ^ 2) FROM (SELECT brand, avg(CAST(revenue AS DOUBLE)) AS a, count(*) AS c FROM sales GROUP BY 1), g) SELECT factor, round(b / (ss - n * m * m), 9) AS eta_squared FROM f, g")
def t09(spark, sf):
    return st.one_way_shares(sales(spark, sf, "region", "brand"), ("region", "brand"), "revenue").select("factor", D("eta_squared", k=9))


@query("t09_multi_way_anova")
def t09m(spark, sf):
    """Region, brand and segment with all pairwise interactions, Type II; t09_variance_decomposition has one-way shares."""
    return grouped.multi_way(sales(spark, sf, "region", "brand", "segment"), ("region", "brand", "segment"), "revenue")


#: The additive model by turns: each factor's effects from the other's, until they stand still. An F with an even first number of degrees of freedom has a finite tail.
TWO_WAY = f"""WITH RECURSIVE {SALES_SQL}, x AS (SELECT region AS a, segment AS b, count(*) AS n, sum(CAST(revenue AS DOUBLE)) AS s, sum(CAST(revenue AS DOUBLE) ^ 2) AS ss FROM sales GROUP BY 1, 2), g AS (SELECT sum(n) AS n, sum(s) / sum(n) AS m, sum(ss) - sum(s) ^ 2 / sum(n) AS total FROM x),
    c AS (SELECT a, b, CAST(x.n AS DOUBLE) AS n, x.s - x.n * m AS s FROM x, g), full_ AS (SELECT p.a, q.b, coalesce(n, 0.0) AS n, coalesce(s, 0.0) AS s FROM (SELECT DISTINCT a FROM c) p CROSS JOIN (SELECT DISTINCT b FROM c) q LEFT JOIN c ON c.a = p.a AND c.b = q.b),
    ra AS (SELECT a, list(n ORDER BY b) AS nr, sum(n) AS ni, sum(s) AS si FROM full_ GROUP BY 1), rb AS (SELECT b, list(n ORDER BY a) AS nr, sum(n) AS ni, sum(s) AS si FROM full_ GROUP BY 1),
    k AS (SELECT (SELECT list(nr ORDER BY a) FROM ra) AS nab, (SELECT list(ni ORDER BY a) FROM ra) AS na, (SELECT list(si ORDER BY a) FROM ra) AS sa, (SELECT list(nr ORDER BY b) FROM rb) AS nba, (SELECT list(ni ORDER BY b) FROM rb) AS nb, (SELECT list(si ORDER BY b) FROM rb) AS sb),
    it AS (SELECT 0 AS t, list_transform(nb, lambda v: CAST(0 AS DOUBLE)) AS vb FROM k UNION ALL SELECT t + 1, list_transform(range(1, len(nb) + 1), lambda j: (sb[j] - list_dot_product(nba[j], va)) / nb[j]) FROM (SELECT t, k.*, list_transform(range(1, len(na) + 1), lambda i: (sa[i] - list_dot_product(nab[i], vb)) / na[i]) AS va FROM it, k WHERE t < 60)),
    z AS (SELECT list_transform(range(1, len(na) + 1), lambda i: (sa[i] - list_dot_product(nab[i], vb)) / na[i]) AS va, vb, k.* FROM it, k WHERE t = 60),
    f AS (SELECT list_dot_product(sa, va) + list_dot_product(sb, vb) AS ab, (SELECT sum(s ^ 2 / n) FROM c) AS cell, (SELECT sum(si ^ 2 / ni) FROM ra) AS sa1, (SELECT sum(si ^ 2 / ni) FROM rb) AS sb1, len(na) AS la, len(nb) AS lb, (SELECT count(*) FROM c) AS cells FROM z),
    t AS (SELECT 'region' AS term, ab - sb1 AS ss, la - 1 AS d FROM f UNION ALL SELECT 'segment', ab - sa1, lb - 1 FROM f UNION ALL SELECT 'region:segment', cell - ab, cells - la - lb + 1 FROM f UNION ALL SELECT 'residual', total - cell, CAST(n AS BIGINT) - cells FROM f, g),
    r AS (SELECT ss AS left_, d AS rest FROM t WHERE term = 'residual'), u AS (SELECT t.*, total, rest, CASE WHEN term <> 'residual' THEN ss / d / (left_ / rest) END AS f FROM t, r, g), y AS (SELECT *, rest / (rest + d * f) AS q FROM u)"""


@query("t10_two_way_anova", f"{TWO_WAY} SELECT term, round(ss / 1e6, 2) AS sum_sq_m, CAST(d AS DOUBLE) AS df, round(ss / total, 10) AS eta_squared, round(f, 5) AS f, round(list_sum(list_transform(range(0, d // 2), lambda k: exp(rest / 2 * ln(q) + lgamma(rest / 2 + k) - lgamma(rest / 2) - lgamma(k + 1) + k * ln(1 - q)))), 6) AS p_value FROM y")
def t10(spark, sf):
    """Region and segment with their interaction, Type II; sums of squares in millions."""
    out = grouped.two_way(sales(spark, sf, "region", "segment"), "region", "segment", "revenue")
    return out.select("term", F.round(C("sum_sq") / 1e6, 2).alias("sum_sq_m"), "df", D("eta_squared", k=10), D("f", k=5), D("p_value", k=6))


MOMENTS = f"""{DENSE}, a AS (SELECT *, avg(value) OVER (PARTITION BY item) AS m FROM s), q AS (SELECT item, count(*) AS n, avg((value - m) ^ 2) AS m2, avg((value - m) ^ 3) AS m3, avg((value - m) ^ 4) AS m4, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM a GROUP BY 1), k AS (SELECT *, m3 / m2 ^ 1.5 AS g1, m4 / m2 ^ 2 - 3 AS g2 FROM q)"""


@query("t11_distribution_shape", f"{MOMENTS} SELECT item, n AS n_observations, round(g1, 6) AS skewness, round(g2, 6) AS excess_kurtosis, round(q[1], 6) AS p5, round(q[2], 6) AS p25, round(q[3], 6) AS p50, round(q[4], 6) AS p75, round(q[5], 6) AS p95 FROM k")
def t11(spark, sf):
    """Quantiles of amounts with four decimals have six: fewer would round halves, which fall either way."""
    out = st.moments(series(spark, sf))
    return out.select("item", "n_observations", D("skewness", k=6), D("excess_kurtosis", k=6), *[D(f"p{k}", k=6) for k in (5, 25, 50, 75, 95)])


@query("t11_normality", f"""{MOMENTS}, b AS (SELECT item, n, CAST(n AS DOUBLE) AS d, g1, g2 + 3 AS b2, g1 * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS y FROM k),
    w AS (SELECT *, -1 + sqrt(2 * (3 * (d * d + 27 * d - 70) * (d + 1) * (d + 3) / ((d - 2) * (d + 5) * (d + 7) * (d + 9)) - 1)) AS w2, (b2 - 3 * (d - 1) / (d + 1)) / sqrt(24 * d * (d - 2) * (d - 3) / ((d + 1) ^ 2 * (d + 3) * (d + 5))) AS x,
          6 * (d * d - 5 * d + 2) / ((d + 7) * (d + 9)) * sqrt(6 * (d + 3) * (d + 5) / (d * (d - 2) * (d - 3))) AS rt FROM b),
    sk AS (SELECT *, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / rt ^ 2)) AS a FROM w),
    z AS (SELECT *, ln(y / sqrt(2 / (w2 - 1)) + sqrt((y / sqrt(2 / (w2 - 1))) ^ 2 + 1)) / sqrt(ln(w2) / 2) AS z1, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM sk),
    t AS (SELECT *, CASE WHEN n >= 8 THEN z1 ^ 2 + z2 ^ 2 END AS k2 FROM z)
    SELECT item, n AS n_observations, round(k2, 6) AS statistic, round(exp(-k2 / 2), 9) AS normality_p_value, coalesce(exp(-k2 / 2) > 0.05, false) AS is_normal,
           CASE WHEN k2 IS NULL THEN 'insufficient' WHEN exp(-k2 / 2) > 0.05 THEN 'normal' WHEN g1 > 0.5 THEN 'right_skewed' WHEN g1 < -0.5 THEN 'left_skewed' WHEN b2 > 4 THEN 'heavy_tailed' ELSE 'non_normal' END AS classification FROM t""")
def t11n(spark, sf):
    """The joint test of skew and kurtosis per item."""
    return st.normality(series(spark, sf)).select("item", "n_observations", D("statistic", k=6), D("normality_p_value", k=9), "is_normal", "classification")


K2 = f"""{MOMENTS}, b AS (SELECT item, n, CAST(n AS DOUBLE) AS d, g1, g2, g2 + 3 AS b2, g1 * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS y FROM k),
    w AS (SELECT *, -1 + sqrt(2 * (3 * (d * d + 27 * d - 70) * (d + 1) * (d + 3) / ((d - 2) * (d + 5) * (d + 7) * (d + 9)) - 1)) AS w2, (b2 - 3 * (d - 1) / (d + 1)) / sqrt(24 * d * (d - 2) * (d - 3) / ((d + 1) ^ 2 * (d + 3) * (d + 5))) AS x,
          6 * (d * d - 5 * d + 2) / ((d + 7) * (d + 9)) * sqrt(6 * (d + 3) * (d + 5) / (d * (d - 2) * (d - 3))) AS rt FROM b),
    sk AS (SELECT *, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / rt ^ 2)) AS a FROM w),
    z AS (SELECT *, ln(y / sqrt(2 / (w2 - 1)) + sqrt((y / sqrt(2 / (w2 - 1))) ^ 2 + 1)) / sqrt(ln(w2) / 2) AS z1, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM sk),
    t AS (SELECT *, exp(-(z1 ^ 2 + z2 ^ 2) / 2) AS p FROM z)"""


@query("t11_distribution_analysis", f"""{K2}, l AS (SELECT item FROM s GROUP BY 1 ORDER BY abs(avg(value)) DESC, item LIMIT 15), j AS (SELECT *, p > 0.05 AND abs(g1) < 0.5 AND abs(g2) < 1 AS ok, concat_ws(', ', CASE WHEN g1 > 0.5 THEN 'skewed_right' WHEN g1 < -0.5 THEN 'skewed_left' END, CASE WHEN g2 > 1 THEN 'heavy_tailed' WHEN g2 < -1 THEN 'light_tailed' END) AS c FROM t WHERE item IN (SELECT item FROM l))
    SELECT item, n AS n_observations, round(g1, 6) AS skewness, round(g2, 6) AS excess_kurtosis, round(p, 9) AS normality_p_value, ok AS is_normal, CASE WHEN c <> '' THEN c WHEN ok THEN 'normal' ELSE 'near_normal' END AS classification, CASE WHEN ok THEN 'high' WHEN abs(g1) > 1 OR abs(g2) > 2 THEN 'low' ELSE 'medium' END AS z_score_reliability FROM j""")
def t11d(spark, sf):
    """The fifteen leading brands: shape, normality, labels, and how far z-scores can be trusted."""
    out = st.distribution(series(spark, sf, keep=True))
    return out.select("item", "n_observations", D("skewness", k=6), D("excess_kurtosis", k=6), D("normality_p_value", k=9), "is_normal", "classification", "z_score_reliability")


@query("t12_bimodality", f"{MOMENTS} SELECT item, round((g1 ^ 2 + 1) / (g2 + 3), 6) AS bimodality, (g1 ^ 2 + 1) / (g2 + 3) > 0.555 AS is_bimodal FROM k WHERE n >= 10")
def t12(spark, sf):
    return st.moments(series(spark, sf)).select("item", D("bimodality", k=6), "is_bimodal")


def _conc(source: str, groups: str, where: str = "true") -> str:
    g, p = (f"{groups}, ", f"PARTITION BY {groups}") if groups else ("", "")
    return f"""r AS (SELECT *, abs(value) AS x, sum(abs(value)) OVER ({p}) AS t FROM {source} WHERE {where}), k AS (SELECT *, row_number() OVER ({p} ORDER BY x DESC, item) AS k, coalesce(sum(x) OVER ({p} ORDER BY x DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER ({p} ORDER BY x, item DESC) AS i FROM r),
    h AS (SELECT {g}count(*) AS total_entities, count(*) FILTER (b < 0.8 * t) AS pareto_count, round(sum(x) FILTER (k <= 5) / max(t), 9) AS top_5_share, round(sum(x) FILTER (k <= 10) / max(t), 9) AS top_10_share, round(sum((100 * x / t) ^ 2), 6) AS hhi, round(2 * sum(i * x) / (count(*) * max(t)) - (count(*) + 1) / count(*), 9) AS gini, sum((100 * x / t) ^ 2) AS hhi_raw, 2 * sum(i * x) / (count(*) * max(t)) - (count(*) + 1) / count(*) AS gini_raw FROM k {'GROUP BY ' + groups if groups else ''})"""


COLS = ("total_entities", "pareto_count", "top_5_share", "top_10_share", "hhi", "gini")
shown = lambda df, *keys: df.select(*keys, "total_entities", "pareto_count", D("top_5_share", k=9), D("top_10_share", k=9), D("hhi", k=6), D("gini", k=9))


@query("t13_concentration", f"{DENSE}, {_conc('s', '', 'period = (SELECT now FROM lately)')} SELECT {', '.join(COLS)} FROM h")
def t13(spark, sf):
    return shown(st.concentration(series(spark, sf).filter(C("period") == latest(spark, sf)[0])))


@query("t14_concentration_trend", f"{DENSE}, {_conc('s', 'period')}, j AS (SELECT h.*, p.period_idx FROM h JOIN p USING (period)) SELECT round(regr_slope(hhi_raw, period_idx), 6) AS hhi_slope, round(regr_slope(gini_raw, period_idx), 9) AS gini_slope, count(*) AS periods, (SELECT round({CORRELATION_P}, 6) FROM (SELECT corr(hhi_raw, period_idx) AS r, count(*) AS n FROM j)) AS hhi_p_value, (SELECT round({CORRELATION_P}, 6) FROM (SELECT corr(gini_raw, period_idx) AS r, count(*) AS n FROM j)) AS gini_p_value FROM j")
def t14(spark, sf):
    out = st.concentration_trend(series(spark, sf))
    return out.select(D("hhi_slope", k=6), D("gini_slope", k=9), "periods", D("hhi_p_value", k=6), D("gini_p_value", k=6))


@query("t15_variance_concentration", f"{DENSE}, d AS (SELECT item, abs(value - lag(value) OVER (PARTITION BY item ORDER BY period)) AS v FROM s), a AS (SELECT item, sum(v) AS value FROM d GROUP BY 1), {_conc('a', '')} SELECT {', '.join(COLS)} FROM h")
def t15(spark, sf):
    d = series(spark, sf).withColumn("v", F.abs(C("value") - per.lagged("value", ("item",)))).groupBy("item").agg(F.sum("v").alias("value"))
    return shown(st.concentration(d))


@query("t16_segmented_concentration", f"{W}, a AS (SELECT region, nation AS item, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE period = (SELECT now FROM lately) GROUP BY 1, 2), {_conc('a', 'region')} SELECT region, {', '.join(COLS)} FROM h")
def t16(spark, sf):
    a = sales(spark, sf, "region", "nation", months=latest(spark, sf)[:1]).groupBy("region", C("nation").alias("item")).agg(F.sum("revenue").cast("double").alias("value"))
    return shown(st.concentration(a, "region"), "region")


METRICS = ("revenue", "quantity", "price", "lines")
TABLE = f"{W}, m AS (SELECT {{}}period, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(revenue) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS price, CAST(count(*) AS DOUBLE) AS lines FROM sales WHERE period <= (SELECT now FROM lately) GROUP BY ALL)"
PAIR_RAW = " UNION ALL ".join(f"SELECT {{0}}'{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {{1}}" for i, a in enumerate(METRICS) for b in METRICS[i + 1 :])
PAIR_SQL = " UNION ALL ".join(f"SELECT {{0}}'{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM m {{1}}" for i, a in enumerate(METRICS) for b in METRICS[i + 1 :])


def metrics(spark, sf, *dims):
    m = sales(spark, sf, *dims, until=latest(spark, sf)[0]).groupBy(*dims, "period").agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("double").alias("quantity"), F.count("*").cast("double").alias("lines"))
    return m.withColumn("price", C("revenue") / F.nullif("quantity", F.lit(0.0)))


@query("t17_metric_correlations", f"{TABLE.format('')} {PAIR_SQL.format('', '')}")
def t17(spark, sf):
    return st.correlations(metrics(spark, sf), METRICS).select("a", "b", D("r", k=6), "n")


PLAIN_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM m" for i, a in enumerate(METRICS) for b in METRICS[i + 1 :])


@query("t17_classified", f"""{TABLE.format('')}, c AS ({PLAIN_PAIRS}), k AS (SELECT *, {CORRELATION_P} AS p FROM c) SELECT a, b, round(r, 6) AS r, n, round(p, 6) AS p_value,
    CASE WHEN abs(r) >= 0.8 THEN 'strong' WHEN abs(r) >= 0.5 AND p <= 0.1 THEN 'significant' ELSE 'weak' END AS classification, a = 'revenue' AND b IN ('quantity', 'price') OR a = 'quantity' AND b = 'price' AS expected FROM k""")
def t17c(spark, sf):
    """Metric pairs with p, class, and whether the contract leads one to expect the relation."""
    expected = ((C("a") == "revenue") & C("b").isin("quantity", "price")) | ((C("a") == "quantity") & (C("b") == "price"))
    kind = F.when(F.abs("r") >= 0.8, "strong").when((F.abs("r") >= 0.5) & (C("p_value") <= 0.10), "significant").otherwise("weak")
    return st.with_p(st.correlations(metrics(spark, sf), METRICS)).select("a", "b", D("r", k=6), "n", D("p_value", k=6), kind.alias("classification"), expected.alias("expected"))


@query("t18_correlations_by_entity", f"{TABLE.format('region, ')} {PAIR_SQL.format('region, ', 'GROUP BY region')}")
def t18(spark, sf):
    return st.correlations(metrics(spark, sf, "region"), METRICS, "region").select("region", "a", "b", D("r", k=6), "n")


@query("t18_correlation_breakdown", f"{TABLE.format('region, ')}, e AS ({PAIR_RAW.format('region, ', 'm GROUP BY region')}), w AS (SELECT period, sum(revenue) AS revenue, sum(quantity) AS quantity, sum(lines) AS lines, sum(revenue) / sum(quantity) AS price FROM m GROUP BY 1), p AS ({PAIR_RAW.format('', 'w')}) SELECT region, a, b, round(e.r, 6) AS r, round(p.r, 6) AS population_r, abs(e.r) < 0.3 OR sign(e.r) <> sign(p.r) AS broken FROM e JOIN p USING (a, b) WHERE abs(p.r) >= 0.8")
def t18b(spark, sf):
    """Pairs that go strongly together in the whole, in each region, and where they don't."""
    cells = kept(metrics(spark, sf, "region"), "metrics")
    whole = cells.groupBy("period").agg(*[F.sum(c).alias(c) for c in ("revenue", "quantity", "lines")]).withColumn("price", C("revenue") / F.nullif("quantity", F.lit(0.0)))
    out = st.compared_correlations(st.correlations(whole, METRICS), st.correlations(cells, METRICS, "region"))
    return out.select("region", "a", "b", D("r", k=6), D("population_r", k=6), "broken")


LAGS = " UNION ALL ".join(f"SELECT '{a}' AS leader, '{b}' AS follower, {k} AS lag, CASE WHEN count(*) >= 6 AND isfinite(corr(x.{a}, y.{b})) THEN corr(x.{a}, y.{b}) ELSE 0 END AS r FROM i x JOIN i y ON y.k = x.k + {k}" for a in METRICS for b in METRICS if a != b for k in range(-6, 7))


@query("t19_lead_lag", f"{TABLE.format('')}, i AS (SELECT *, row_number() OVER (ORDER BY period) AS k FROM m), l AS ({LAGS}), z AS (SELECT leader, follower, arg_max(lag, (round(abs(r), 12), -lag)) AS optimal_lag, arg_max(r, (round(abs(r), 12), -lag)) AS lag_r, max(CASE WHEN lag = 0 THEN r END) AS contemporaneous_r FROM l WHERE (SELECT count(*) FROM i) >= 12 GROUP BY 1, 2) SELECT leader, follower, CAST(optimal_lag AS INTEGER) AS optimal_lag, round(lag_r, 6) AS lag_r, round(contemporaneous_r, 6) AS contemporaneous_r, round(abs(lag_r) - abs(contemporaneous_r), 6) AS improvement, abs(lag_r) >= 0.5 AND abs(lag_r) - abs(contemporaneous_r) >= 0.1 AS leads FROM z WHERE optimal_lag > 0 AND abs(lag_r) - abs(contemporaneous_r) >= 0.01")
def t19(spark, sf):
    """Pairs that are better at a lag by any 0.01, and which ones lead by the rule's 0.5 and 0.1."""
    wide = metrics(spark, sf).withColumn("period_idx", F.row_number().over(Window.orderBy("period")))
    out = st.lead_lag(wide, METRICS, least_r=0.0, gain=0.01)
    leads = (F.abs("lag_r") >= 0.5) & (C("improvement") >= 0.1)
    return out.select("leader", "follower", "optimal_lag", D("lag_r", k=6), D("contemporaneous_r", k=6), D("improvement", k=6), leads.alias("leads"))


@query("t20_granger")
def t20(spark, sf):
    """Whether a metric's past helps to predict another's, for each region."""
    m = metrics(spark, sf, "region").withColumn("period_idx", F.row_number().over(Window.partitionBy("region").orderBy("period")))
    pairs = F.array(F.struct(F.lit("quantity").alias("a"), C("quantity").alias("x"), F.lit("price").alias("b"), C("price").alias("y")), F.struct(F.lit("price").alias("a"), C("price").alias("x"), F.lit("revenue").alias("b"), C("revenue").alias("y")))
    long = m.select("region", "period_idx", F.explode(pairs).alias("p")).select(F.concat_ws(" ", "region", "p.a").alias("leader"), F.concat_ws(" ", "region", "p.b").alias("follower"), "period_idx", "p.x", "p.y")
    return grouped.granger(long)


@query("t21_seasonal_trend", f"""{DENSE}, c AS (SELECT *, count(*) OVER (PARTITION BY item) AS n, (sum(value) OVER (PARTITION BY item ORDER BY period ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(value, 6) OVER (PARTITION BY item ORDER BY period) + lead(value, 6) OVER (PARTITION BY item ORDER BY period)) / 2) / 12 AS trend FROM s) SELECT item, period, round(trend, 4) AS trend FROM c WHERE period_idx > 6 AND period_idx <= n - 6""", dates="period")
def t21(spark, sf):
    parts = st.seasonal(series(spark, sf, keep=True))
    n = F.max("period_idx").over(Window.partitionBy("item"))
    return parts.withColumn("n", n).filter((C("period_idx") > 6) & (C("period_idx") <= C("n") - 6)).select("item", "period", D("trend"))


SEASONAL = f"""{DENSE}, c AS (SELECT *, count(*) OVER (PARTITION BY item) AS n, (sum(value) OVER (PARTITION BY item ORDER BY period ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(value, 6) OVER w + lead(value, 6) OVER w) / 2) / 12 AS inner_mean FROM s WINDOW w AS (PARTITION BY item ORDER BY period)),
    m AS (SELECT *, CASE WHEN period_idx > 6 AND period_idx <= n - 6 THEN inner_mean END AS mid FROM c WHERE n >= 24),
    e AS (SELECT item, regr_slope(mid, period_idx) FILTER (period_idx <= 18) AS b0, regr_intercept(mid, period_idx) FILTER (period_idx <= 18) AS a0, regr_slope(mid, period_idx) FILTER (period_idx > n - 18) AS b1, regr_intercept(mid, period_idx) FILTER (period_idx > n - 18) AS a1 FROM m GROUP BY 1),
    t AS (SELECT m.*, coalesce(mid, CASE WHEN period_idx <= 6 THEN a0 + b0 * period_idx ELSE a1 + b1 * period_idx END) AS trend, (period_idx - 1) % 12 AS phase FROM m JOIN e USING (item)),
    f AS (SELECT item, phase, avg(value - mid) AS e FROM t GROUP BY 1, 2), g AS (SELECT item, phase, e - avg(e) OVER (PARTITION BY item) AS seasonal FROM f),
    r AS (SELECT item, value - trend - seasonal AS residual, value - trend AS loose FROM t JOIN g USING (item, phase)),
    q AS (SELECT *, avg(residual) OVER (PARTITION BY item) AS rm, stddev_samp(residual) OVER (PARTITION BY item) AS sd FROM r)"""


@query("t21_seasonal_summary", f"""{SEASONAL} SELECT item, round(avg(residual), 4) AS residual_mean, round(stddev_samp(residual), 4) AS residual_std, count(*) FILTER (abs(residual - rm) > 2 * sd) AS anomaly_count, round(greatest(0, 1 - var_pop(residual) / nullif(var_pop(loose), 0)), 6) AS seasonal_strength FROM q GROUP BY 1""")
def t21s(spark, sf):
    return st.seasonal_summary(kept(st.seasonal(series(spark, sf, keep=True)), "seasonal")).select("item", D("residual_mean"), D("residual_std"), "anomaly_count", D("seasonal_strength", k=6))


@query("t21_adjusted_yoy", f"""{SEASONAL}, h AS (SELECT t.item, t.period_idx, t.n, t.value, t.value - g.seasonal AS clean FROM t JOIN g USING (item, phase)) SELECT item, round(max(value) FILTER (period_idx = n) - max(value) FILTER (period_idx = n - 12), 4) AS yoy_variance_raw, round(max(clean) FILTER (period_idx = n) - max(clean) FILTER (period_idx = n - 12), 4) AS yoy_variance_seasonal_adjusted FROM h GROUP BY 1""")
def t21y(spark, sf):
    parts = kept(st.seasonal(series(spark, sf, keep=True)), "seasonal")
    return st.adjusted_yoy(parts).select("item", D("yoy_variance_raw"), D("yoy_variance_seasonal_adjusted"))


#: Lists of each item's values; the cheapest cut of the first e of them, for one e after the other, and the way back from the last.
LISTS = DENSE.replace("WITH ", "WITH RECURSIVE ", 1) + """, v AS (SELECT item, list(value ORDER BY period) AS v, list(period ORDER BY period) AS d, count(*) AS n, var_pop(value) AS vp FROM s GROUP BY 1)"""
CHANGES = LISTS + """, w AS (SELECT item, v, d, n, 3 * greatest(vp, 1e-12) * ln(n) AS pen, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(v[1:k]), 0)) AS c1, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(list_transform(v[1:k], lambda y: y * y)), 0)) AS c2 FROM v WHERE n >= 12),
    r AS (SELECT item, CAST(0 AS BIGINT) AS e, [-pen] AS b, [CAST(0 AS BIGINT)] AS k FROM w UNION ALL SELECT item, e + 1, list_append(b, CASE WHEN e + 1 < 3 THEN 1e300 ELSE list_min(x) END), list_append(k, CASE WHEN e + 1 < 3 THEN 0 ELSE CAST(list_position(x, list_min(x)) - 1 AS BIGINT) END)
        FROM (SELECT r.item, e, b, k, list_transform(range(0, e - 1), lambda s: b[s + 1] + (c2[e + 2] - c2[s + 1]) - (c1[e + 2] - c1[s + 1]) ^ 2 / (e + 1 - s) + pen) AS x FROM r JOIN w USING (item) WHERE e < n)),
    fin AS (SELECT item, k FROM r JOIN w USING (item) WHERE e = n), bt AS (SELECT item, k[len(k)] AS pos FROM fin UNION ALL SELECT bt.item, fin.k[pos + 1] FROM bt JOIN fin USING (item) WHERE pos > 0),
    cp AS (SELECT bt.item, d[pos + 1] AS period, pos, list_avg(v[1:pos]) AS bm, list_avg(v[pos + 1:n]) AS am, list_stddev_pop(v[1:pos]) AS sd, pos AS nb, n - pos AS na FROM bt JOIN w ON w.item = bt.item WHERE pos > 0)"""


@query("t22_change_points", f"{CHANGES} SELECT item, period, CAST(pos AS INTEGER) AS change_point_index, round(bm, 4) AS before_mean, round(am, 4) AS after_mean, round(am - bm, 4) AS magnitude_dollar, round(100 * (am - bm) / abs(bm), 5) AS magnitude_pct, round(CASE WHEN sd > 0 THEN least(abs(am - bm) / sd, 10) ELSE 0 END, 6) AS confidence_score, CAST(nb AS INTEGER) AS periods_before, CAST(na AS INTEGER) AS periods_after FROM cp", dates="period")
def t22(spark, sf):
    out = grouped.change_points(series(spark, sf))
    return out.select("item", "period", "change_point_index", D("before_mean"), D("after_mean"), D("magnitude_dollar"), D("magnitude_pct", k=5), D("confidence_score", k=6), "periods_before", "periods_after")


FORECASTS = LISTS + """, i AS (SELECT *, unnest(range(train, n)) AS i FROM (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS train FROM v) WHERE n >= 18 AND train >= 12),
    f0 AS (SELECT item, d[i + 1] AS period, v[i + 1] AS actual, CASE WHEN train >= 24 THEN v[train - 12 + (i - train) % 12 + 1] + (list_avg(v[train - 11:train]) - list_avg(v[train - 23:train - 12])) * ((i - train) // 12 + 1) ELSE list_avg(v[1:train]) END AS forecast FROM i),
    fc AS (SELECT *, CASE WHEN forecast <> 0 THEN 100 * (actual - forecast) / abs(forecast) ELSE 0 END AS pct FROM f0)"""


@query("t23_forecast_holdout", f"{FORECASTS} SELECT item, period, round(actual, 4) AS actual, round(forecast, 4) AS forecast, round(actual - forecast, 4) AS variance_dollar, round(pct, 5) AS variance_pct, round(abs(pct), 5) AS abs_variance_pct, abs(pct) > 10 AS miss FROM fc", dates="period")
def t23(spark, sf):
    out = grouped.holdout_forecasts(series(spark, sf))
    return out.select("item", "period", *[D(c) for c in ("actual", "forecast", "variance_dollar")], D("variance_pct", k=5), D("abs_variance_pct", k=5), "miss")


@query("t23_forecast_summary", f"{FORECASTS} SELECT count(DISTINCT item) AS items_analyzed, count(*) AS total_forecasts, count(*) FILTER (abs(pct) > 10) AS total_forecast_misses, count(DISTINCT item) FILTER (abs(pct) > 10) AS items_with_misses, round(100 * avg(CASE WHEN abs(pct) > 10 THEN 1.0 ELSE 0 END), 6) AS miss_rate_pct, round(avg(abs(pct)), 5) AS mape FROM fc")
def t23s(spark, sf):
    out = grouped.forecast_summary(grouped.holdout_forecasts(series(spark, sf)))
    return out.select("items_analyzed", "total_forecasts", "total_forecast_misses", "items_with_misses", D("miss_rate_pct", k=6), D("mape", k=5))


#: Weights tried, the state after the first cycle, and one value after the other up to the end of the history; the least squared errors win.
FITTED = LISTS + """, w AS (SELECT *, v[1:train] AS x, train >= 24 AS cyc, list_avg(v[1:12]) AS m1, (list_avg(v[13:24]) - list_avg(v[1:12])) / 12 AS dr FROM (SELECT *, CAST(floor(n * 0.8) AS INTEGER) AS train FROM v) WHERE n >= 18),
    g AS (SELECT *, unnest(CASE WHEN cyc THEN [0.1, 0.3, 0.6] ELSE [0.0] END)::DOUBLE AS c FROM (SELECT *, unnest(CASE WHEN cyc THEN [0, 0.05, 0.2] ELSE [0.0] END)::DOUBLE AS b FROM (SELECT *, unnest([0.05, 0.2, 0.4, 0.6, 0.8])::DOUBLE AS a FROM w))),
    h AS (SELECT item, a, b, c, x, train, CASE WHEN cyc THEN 12 ELSE 1 END AS i, CASE WHEN cyc THEN m1 + dr * 5.5 ELSE x[1] END AS l, CASE WHEN cyc THEN dr ELSE 0.0 END AS t, CASE WHEN cyc THEN list_transform(range(0, 12), lambda k: x[k + 1] - m1 - dr * (k - 5.5)) ELSE list_transform(range(0, 12), lambda k: 0.0::DOUBLE) END AS s, 0.0::DOUBLE AS e FROM g
        UNION ALL SELECT item, a, b, c, x, train, i + 1, nl, b * (nl - l) + (1 - b) * t, list_append(s[2:12], c * (y - nl) + (1 - c) * s[1]), e + (y - l - t - s[1]) ^ 2 FROM (SELECT *, x[i + 1] AS y, a * (x[i + 1] - s[1]) + (1 - a) * (l + t) AS nl FROM h WHERE i < train)),
    best AS (SELECT * FROM h WHERE i = train QUALIFY row_number() OVER (PARTITION BY item ORDER BY e, a, b, c) = 1),
    fc AS (SELECT item, d[i + k + 1] AS period, a AS alpha, b AS beta, c AS gamma, v[i + k + 1] AS actual, l + (k + 1) * t + s[k % 12 + 1] AS forecast FROM (SELECT best.*, v.d, v.v, unnest(range(0, v.n - i)) AS k FROM best JOIN v USING (item)))"""


@query("t23_fitted_forecast", f"{FITTED} SELECT item, period, alpha, beta, gamma, round(actual, 4) AS actual, round(forecast, 3) AS forecast, round(CASE WHEN forecast <> 0 THEN 100 * (actual - forecast) / abs(forecast) ELSE 0 END, 5) AS variance_pct FROM fc", dates="period")
def t23f(spark, sf):
    """Forecasts of the last fifth with weights fitted to each item's history."""
    return fitted_forecasts(series(spark, sf)).select("item", "period", "alpha", "beta", "gamma", D("actual"), D("forecast", k=3), D("variance_pct", k=5))


@query("t24_temporal_grain", f"{W}, p AS (SELECT DISTINCT period FROM sales), g AS (SELECT period - lag(period) OVER (ORDER BY period) AS gap FROM p) SELECT (SELECT count(*) FROM p) AS periods, round(avg(CASE WHEN gap BETWEEN 27 AND 32 THEN 1.0 ELSE 0 END), 9) AS monthly, 'monthly' AS grain FROM g WHERE gap IS NOT NULL")
def t24(spark, sf):
    g = per.grain(sales(spark, sf), "period")
    return g.select("periods", D("monthly", k=9), "grain")
