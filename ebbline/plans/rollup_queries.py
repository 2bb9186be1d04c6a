"""Queries of roll-ups and aggregations (A)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..operators import rollup
from ..operators.ordered import with_totals
from ..sources.loaders import period_aggregate
from ..sources.sinks import kept
from . import contract
from .catalog import query
from .facts import EVENTS_SQL, SALES_SQL, events, latest, sales, table

C = F.col
W = f"WITH {SALES_SQL}"
D = lambda c, n=None: F.round(C(c).cast("double"), 6).alias(n or c)


@query("a01_period_aggregate", f"{W} SELECT period, region, CAST(sum(revenue) AS DOUBLE) AS revenue, round(avg(discount), 12) AS avg_discount, count(DISTINCT customer) AS n_customer FROM sales GROUP BY 1, 2", dates="period")
def a01(spark, sf):
    out = period_aggregate(sales(spark, sf, "region", "customer", "discount"), "order_date", "monthly", ("region",), ("revenue",), ("discount",), ("customer",))
    return out.select("period", "region", D("revenue"), F.round("avg_discount", 12).alias("avg_discount"), "n_customer")


def _bucket(name: str, sql: str, grain: str):
    @query(name, f"{W} SELECT CAST({sql} AS DATE) AS period, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS quantity FROM sales GROUP BY 1", dates="period")
    def run(spark, sf):
        return sales(spark, sf).groupBy(dt.BUCKETS[grain](C("order_date")).alias("period")).agg(F.count("*").alias("n"), F.sum("quantity").cast("double").alias("quantity"))


_bucket("a02_month_end", "last_day(order_date)", "monthly")
_bucket("a03_week_end_saturday", "order_date + CAST(6 - dayofweek(order_date) AS INTEGER)", "weekly_saturday")
_bucket("a04_day", "order_date", "daily")


@query("a05_year_month_columns", f"{W} SELECT last_day(make_date(year(ship_date), month(ship_date), 1)) AS period, count(*) AS n FROM sales GROUP BY 1", dates="period")
def a05(spark, sf):
    df = sales(spark, sf).select(F.year("ship_date").alias("y"), F.month("ship_date").alias("m"))
    return df.groupBy(dt.month_end_of(C("y"), C("m")).alias("period")).agg(F.count("*").alias("n"))


@query("a06_post_aggregate_expression", f"{W} SELECT period, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS DOUBLE) AS quantity, round(CAST(sum(revenue) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE), 6) AS price FROM sales GROUP BY 1", dates="period")
def a06(spark, sf):
    out = period_aggregate(sales(spark, sf), "order_date", "monthly", (), ("revenue", "quantity"), derived={"price": "cast(revenue AS double) / nullif(cast(quantity AS double), 0)"})
    return out.select("period", D("revenue"), D("quantity"), D("price"))


@query("a07_temporal_rollup", f"WITH {EVENTS_SQL} SELECT CAST(day + CAST(7 - isodow(day) AS INTEGER) AS DATE) AS day, metric, CAST(sum(value) AS DOUBLE) AS value FROM ev GROUP BY 1, 2", dates="day")
def a07(spark, sf):
    out = rollup.to_grain(events(spark, sf), "day", "weekly", ("metric",), (contract.Metric("value"),))
    return out.select("day", "metric", C("value").cast("double"))


@query("a08_metric_aware_rollup", f"WITH {EVENTS_SQL} SELECT metric, last_day(day) AS day, CAST(CASE WHEN metric = 'click' THEN max(value) WHEN metric = 'view' THEN avg(value) ELSE sum(value) END AS DOUBLE) AS value FROM ev GROUP BY 1, 2", dates="day")
def a08(spark, sf):
    metrics = (contract.Metric("click", tags=("cumulative",)), contract.Metric("view", type="non_additive"), contract.Metric("purchase"))
    df = events(spark, sf).withColumn("value", C("value").cast("double"))
    return rollup.long_to_grain(df, "day", "monthly", (), metrics)


@query("a09_dimension_rollup", f"{W} SELECT period, region, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY 1, 2", dates="period")
def a09(spark, sf):
    out = rollup.without_children(sales(spark, sf, "region", "nation"), ("period", "region", "nation"), ("nation",), (), (contract.Metric("revenue"),))
    return out.select("period", "region", D("revenue"))


@query("a10_aggregation_rules", f"{W} SELECT region, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(max(quantity) AS DOUBLE) AS peak, round(avg(discount), 6) AS discount FROM sales GROUP BY 1")
def a10(spark, sf):
    metrics = (contract.Metric("revenue"), contract.Metric("peak", column="quantity", tags=("cumulative",)), contract.Metric("discount", type="ratio"))
    return sales(spark, sf, "region", "discount").groupBy("region").agg(*[contract.rolled(m) for m in metrics]).select("region", D("revenue"), D("peak"), D("discount"))


@query("a11_row_budget", f"{W} SELECT segment, region, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY 1, 2")
def a11(spark, sf):
    out, _ = rollup.within_rows(sales(spark, sf, "region", "segment", "customer"), ("region", "segment", "customer"), (contract.Metric("revenue"),), 30)
    return out.select("segment", "region", D("revenue"))


@query("a12_auto_weekly", f"WITH {EVENTS_SQL} SELECT CAST(day + CAST(7 - isodow(day) AS INTEGER) AS DATE) AS day, CAST(sum(value) AS DOUBLE) AS value FROM ev GROUP BY 1", dates="day")
def a12(spark, sf):
    out = rollup.auto_weekly(events(spark, sf), "day", (), (contract.Metric("value"),), 500)
    return out.select("day", C("value").cast("double"))


@query("a13_period_totals", f"{W} SELECT period, CAST(sum(revenue) AS DOUBLE) AS total FROM sales GROUP BY 1", dates="period")
def a13(spark, sf):
    return rollup.period_totals(sales(spark, sf), "revenue").select("period", D("total"))


@query("a14_period_ratio", f"{W} SELECT period, round(100 * CAST(sum(revenue) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE), 6) AS ratio FROM sales GROUP BY 1", dates="period")
def a14(spark, sf):
    return sales(spark, sf).groupBy("period").agg(F.round(rollup.ratio("sum(revenue)", "sum(quantity)", 100.0), 6).alias("ratio"))


@query("a15_daily_average_ratio", f"WITH {EVENTS_SQL} SELECT last_day(day) AS period, round(CAST(sum(value) FILTER (metric = 'purchase') AS DOUBLE) / (CAST(sum(value) FILTER (metric = 'view') AS DOUBLE) / max(day(day))), 6) AS ratio FROM ev GROUP BY 1", dates="period")
def a15(spark, sf):
    df = events(spark, sf).withColumn("period", F.last_day("day"))
    return rollup.long_ratio(df, ("period",), "purchase", "view", days=F.max(F.dayofmonth("day"))).select("period", D("ratio"))


@query("a16_level_sums", f"{W} SELECT coalesce(nullif(brand, 'Brand#11'), '(Unassigned)') AS item, CAST(sum(revenue) AS DOUBLE) AS total FROM sales WHERE period = (SELECT now FROM lately) GROUP BY 1")
def a16(spark, sf):
    df = sales(spark, sf, "brand", months=latest(spark, sf)[:1]).withColumn("brand", F.nullif("brand", F.lit("Brand#11")))
    return rollup.level_sums(df, "brand", "revenue").select("item", D("total"))


@query("a17_level_ratio", f"{W} SELECT coalesce(region, 'Total') AS item, round(CAST(sum(revenue) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE), 6) AS ratio FROM sales GROUP BY GROUPING SETS ((region), ())")
def a17(spark, sf):
    leaves = sales(spark, sf, "region").groupBy("region").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"))
    return rollup.all_levels(leaves, ("region",), rollup.ratio("sum(revenue)", "sum(quantity)").alias("ratio")).select("item", D("ratio"))


@query("a18_deduplicated_denominator", """WITH o AS (SELECT o_orderpriority AS p, o_orderkey AS k, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS n, max(CAST(o_totalprice AS DECIMAL(18,2))) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT p AS item, sum(n) AS numerator, CAST(sum(d) AS DOUBLE) AS denominator, round(sum(n) / CAST(sum(d) AS DOUBLE), 9) AS ratio FROM o GROUP BY 1""")
def a18(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), C("l_orderkey") == C("o_orderkey")).select("o_orderpriority", "o_orderkey", C("l_quantity").cast("decimal(18,2)").alias("n"), C("o_totalprice").cast("decimal(18,2)").alias("d"))
    return rollup.deduplicated_ratio(df, "o_orderpriority", ("o_orderkey",), "n", "d").withColumn("ratio", F.round("ratio", 9))


@query("a19_long_form_ratio", f"WITH {EVENTS_SQL} SELECT day, round(CAST(sum(value) FILTER (metric = 'purchase') AS DOUBLE) / CAST(sum(value) FILTER (metric = 'click') AS DOUBLE), 6) AS ratio FROM ev GROUP BY 1", dates="day")
def a19(spark, sf):
    return rollup.long_ratio(events(spark, sf), ("day",), "purchase", "click").select("day", D("ratio"))


@query("a20_material_shares", f"{W}, s AS (SELECT period, nation, sum(quantity) AS q FROM sales GROUP BY 1, 2), k AS (SELECT period, nation FROM (SELECT *, CAST(q AS DOUBLE) / CAST(sum(q) OVER (PARTITION BY period) AS DOUBLE) AS sh FROM s) WHERE sh >= 0.05) SELECT period, nation, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales JOIN k USING (period, nation) GROUP BY 1, 2", dates="period")
def a20(spark, sf):
    monthly = sales(spark, sf, "nation").groupBy("period", "nation").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"))
    return rollup.material(monthly, "nation", "quantity", 0.05).select("period", "nation", D("revenue"))


@query("a21_all_levels", f"{W} SELECT CASE WHEN grouping(region) = 1 THEN 0 WHEN grouping(nation) = 1 THEN 1 ELSE 2 END AS level, region, nation, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY ROLLUP (region, nation)")
def a21(spark, sf):
    leaves = sales(spark, sf, "region", "nation").groupBy("region", "nation").agg(F.sum("revenue").alias("revenue"))
    return rollup.all_levels(leaves, ("region", "nation"), F.sum("revenue").alias("revenue")).select("level", "region", "nation", D("revenue"))


@query("a22_order_aggregates", f"""{W} SELECT strftime(order_date, '%Y-%m') AS month, region, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS DOUBLE) AS quantity, count(*) AS lines, count(DISTINCT order_id) AS orders,
    round(CAST(sum(revenue) AS DOUBLE) / count(DISTINCT order_id), 6) AS revenue_per_order FROM sales GROUP BY GROUPING SETS ((1, 2), (1), ())""")
def a22(spark, sf):
    df = sales(spark, sf, "region", "order_id").withColumn("month", F.date_format("order_date", "yyyy-MM"))
    out = rollup.order_summary(df, "month", "region", "order_id", "revenue", "quantity")
    return out.select("month", "region", D("revenue"), D("quantity"), "lines", "orders", F.round(C("revenue").cast("double") / C("orders"), 6).alias("revenue_per_order"))


@query("a23_full_year_yoy", f"{W} SELECT brand, CAST(sum(revenue) FILTER (year(order_date) = 2000) AS DOUBLE) AS current, CAST(sum(revenue) FILTER (year(order_date) = 1999) AS DOUBLE) AS prior FROM sales WHERE year(order_date) IN (1999, 2000) GROUP BY 1")
def a23(spark, sf):
    df = sales(spark, sf, "brand", since=datetime.date(1999, 1, 1), until=datetime.date(2000, 12, 31))
    return rollup.year_pair(df, "brand", "order_date", "revenue", 2000)


@query("a24_children", "SELECT r_name AS region, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS children FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a24(spark, sf):
    df = table(spark, sf, "nation").join(table(spark, sf, "region"), C("n_regionkey") == C("r_regionkey")).select(C("r_name").alias("region"), C("n_name").alias("nation"))
    return rollup.children_of(df, "region", "nation").withColumn("children", F.array_join("children", ","))


@query("a25_summary_stats", f"""{W}, t AS (SELECT period, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1), i AS (SELECT nation, period, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1, 2), c AS (SELECT nation, stddev_pop(v) / avg(v) AS cv FROM i GROUP BY 1)
    SELECT (SELECT count(DISTINCT nation) FROM sales) AS items, count(*) AS periods, min(period) AS first_period, max(period) AS last_period, arg_max(period, v) AS highest_period, arg_min(period, v) AS lowest_period, (SELECT count(*) FROM c WHERE cv >= 0.2) AS high_cv FROM t""", dates="first_period last_period highest_period lowest_period")
def a25(spark, sf):
    return rollup.series_summary(sales(spark, sf, "nation"), "nation", "revenue")


@query("a26_profile", """SELECT 'o_totalprice' AS "column", count(*) AS rows, count(o_totalprice) AS filled, count(DISTINCT o_totalprice) AS "distinct", min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM orders
    UNION ALL SELECT 'o_custkey', count(*), count(o_custkey), count(DISTINCT o_custkey), min(o_custkey), max(o_custkey), round(avg(o_custkey), 4), round(stddev_samp(o_custkey), 4) FROM orders""")
def a26(spark, sf):
    from ..operators.quality import profile

    return profile(table(spark, sf, "orders"), ("o_totalprice", "o_custkey"))


@query("a27_scenario_summaries", f"""WITH {EVENTS_SQL}, t AS (SELECT metric, count(*) AS rows, CAST(sum(value) AS DOUBLE) AS total, avg(CAST(value AS DOUBLE)) AS mean, min(day) AS first_day, max(day) AS last_day FROM ev GROUP BY 1)
    SELECT metric, rows, total, round(mean, 6) AS mean, round(100 * total / sum(total) OVER (), 6) AS share_pct, first_day, last_day, round(100 * (mean / (SELECT mean FROM t WHERE metric = 'view') - 1), 6) AS deviation_pct FROM t""", dates="first_day last_day")
def a27(spark, sf):
    t = rollup.scenario_summaries(events(spark, sf), "metric", "value", "day", "view")
    return t.select("metric", "rows", "total", D("mean"), F.round("share_pct", 6).alias("share_pct"), "first_day", "last_day", F.round("deviation_pct", 6).alias("deviation_pct"))


@query("a28_flagged_baseline", f"{W} SELECT region, round(avg(CAST(revenue AS DOUBLE)) FILTER (flag = 'R'), 4) AS flagged, round(avg(CAST(revenue AS DOUBLE)) FILTER (flag <> 'R'), 4) AS baseline, round(100 * (avg(CAST(revenue AS DOUBLE)) FILTER (flag = 'R') / avg(CAST(revenue AS DOUBLE)) FILTER (flag <> 'R') - 1), 4) AS deviation_pct FROM sales GROUP BY 1")
def a28(spark, sf):
    out = rollup.flagged_against_rest(sales(spark, sf, "region", "flag"), ("region",), "flag", "revenue", ("R",))
    return out.select("region", F.round("flagged", 4).alias("flagged"), F.round("baseline", 4).alias("baseline"), F.round("deviation_pct", 4).alias("deviation_pct"))


@query("a29_run_metadata", f"{W} SELECT count(*) AS rows, count(DISTINCT nation) AS entities, count(DISTINCT period) AS periods FROM sales")
def a29(spark, sf):
    return rollup.run_metadata(sales(spark, sf, "nation"), "nation")


@query("a30_calendar_seasonality", f"""{W}, t AS (SELECT period, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE period <= (SELECT now FROM lately) GROUP BY 1), m AS (SELECT month(period) AS m, avg(v) AS v FROM t GROUP BY 1)
    SELECT CAST(arg_max(m, v) AS INTEGER) AS peak, CAST(arg_min(m, v) AS INTEGER) AS trough, round(100 * (max(v) - min(v)) / avg(v), 6) AS amplitude_pct FROM m""")
def a30(spark, sf):
    t = sales(spark, sf, until=latest(spark, sf)[0]).groupBy("period").agg(F.sum("revenue").cast("double").alias("v"))
    return rollup.calendar_seasonality(t, "v").select("peak", "trough", F.round("amplitude_pct", 6).alias("amplitude_pct"))
