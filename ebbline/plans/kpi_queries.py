"""Queries of derived metrics (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi
from .catalog import query
from .contract import Kpi
from .facts import SALES_SQL, latest, sales
from .variance_queries import monthly

C = F.col
W = f"WITH {SALES_SQL}"
D = lambda c, n=None, k=6: F.round(C(c).cast("double"), k).alias(n or c)
KPIS = (Kpi("price", "revenue", denominator="quantity"), Kpi("net", "revenue", subtract=("rebate",)), Kpi("net_price", "net", denominator="quantity"), Kpi("per_day", "revenue", divide_by="period_days"))
BY_NAME = {k.name: k for k in KPIS}
TOTAL = f"{W}, t AS (SELECT period, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(day(period) AS DOUBLE) AS days FROM sales GROUP BY 1)"


def _totals(spark, sf):
    return sales(spark, sf).groupBy("period").agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("double").alias("quantity"))


@query("d02_ratio_parts", f"{W} SELECT region, round(CAST(sum(revenue) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE), 6) AS price FROM sales GROUP BY 1")
def d02(spark, sf):
    n, d = kpi.ratio_parts(BY_NAME["price"], BY_NAME, ["revenue", "quantity"])
    return sales(spark, sf, "region").groupBy("region").agg(F.round(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), 6).alias("price"))


@query("d05_derived_series", f"{TOTAL}, p AS (SELECT period, revenue / quantity AS value FROM t), l AS (SELECT *, lag(value) OVER (ORDER BY period) AS b FROM p) SELECT period, round(value, 6) AS value, round(100 * (value - b) / abs(b), 6) AS trend_pct, coalesce(100 * (value - b) / abs(b) < -5, false) AS degraded FROM l", dates="period")
def d05(spark, sf):
    s = kpi.derived_series(sales(spark, sf), (), (BY_NAME["price"],), BY_NAME)
    return kpi.with_trend(s, "price").select("period", D("price", "value"), D("trend_pct"), "degraded")


@query("d06_row_formula", f"{W} SELECT region, round(avg(CAST(revenue AS DOUBLE) / CAST(quantity AS DOUBLE)), 6) AS unit_price FROM sales GROUP BY 1")
def d06(spark, sf):
    from .contract import checked

    df = sales(spark, sf, "region").withColumn("revenue", C("revenue").cast("double")).withColumn("quantity", C("quantity").cast("double"))
    return df.withColumn("unit_price", checked("revenue / quantity", df.columns)).groupBy("region").agg(F.round(F.avg("unit_price"), 6).alias("unit_price"))


@query("d07_kpi_table", f"{TOTAL} SELECT period, round(revenue / quantity, 6) AS price, round(revenue - quantity, 4) AS net, round((revenue - quantity) / quantity, 6) AS net_price, round(revenue / days, 6) AS per_day FROM t", dates="period")
def d07(spark, sf):
    t = _totals(spark, sf).withColumn("rebate", C("quantity"))
    out = kpi.sequential(t, KPIS, F.dayofmonth("period").cast("double"))
    return out.select("period", D("price"), D("net", k=4), D("net_price"), D("per_day"))


@query("d08_fixed_ratios", f"{W}, t AS (SELECT period, CAST(sum(revenue) AS DOUBLE) AS r, CAST(sum(quantity) AS DOUBLE) AS q, count(*) AS l, count(DISTINCT order_id) AS o FROM sales GROUP BY 1) SELECT period, round(r / o, 6) AS revenue_per_order, round(r / l, 6) AS revenue_per_line, round(q / o, 6) AS units_per_order, round(l / o, 6) AS lines_per_order FROM t", dates="period")
def d08(spark, sf):
    t = sales(spark, sf, "order_id").groupBy("period").agg(F.sum("revenue").cast("double").alias("r"), F.sum("quantity").cast("double").alias("q"), F.count("*").cast("double").alias("l"), F.count_distinct("order_id").cast("double").alias("o"))
    fixed = (Kpi("revenue_per_order", "r", denominator="o"), Kpi("revenue_per_line", "r", denominator="l"), Kpi("units_per_order", "q", denominator="o"), Kpi("lines_per_order", "l", denominator="o"))
    return kpi.sequential(t, fixed, F.lit(1.0)).select("period", *[D(k.name) for k in fixed])


@query("d10_utilisation", f"{W}, t AS (SELECT period, CAST(sum(quantity) AS DOUBLE) AS v FROM sales WHERE period <= (SELECT now FROM lately) GROUP BY 1), x AS (SELECT period, v, 100 * (v - avg(v) OVER ()) / abs(avg(v) OVER ()) AS d, row_number() OVER (ORDER BY period DESC) AS r FROM t) SELECT period, v AS quantity, round(d, 6) AS vs_mean_pct, CASE WHEN d >= -5 THEN 'OK' WHEN d >= -10 THEN 'WARNING' ELSE 'DEGRADED' END AS status FROM x WHERE r <= 13", dates="period")
def d10(spark, sf):
    s = monthly(spark, sf, until=latest(spark, sf)[0]).select("period", C("quantity").cast("double"))
    return kpi.utilisation(s, "quantity").select("period", "quantity", D("vs_mean_pct"), "status")
