"""The fact tables that contracts run on, joined from the supplied tables as far as a query asks."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import periods as per

#: Months at the end of the calendar that aren't complete yet.
LAG = 1
GEO, CUSTOMER, PRODUCT, MAKER = {"region", "nation"}, {"customer", "segment"}, {"brand", "ptype"}, {"maker", "maker_nation"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(x: Column, scale: int) -> Column:
    """A double as decimal(18, scale), so that sums don't depend on their order; null if it is no number or too large.

    Rounding to whole units of the last place keeps to primitive values; a cast from double would print and parse each one.
    """
    units = F.rint(x * 10.0**scale).try_cast("long").try_cast("decimal(18,0)")
    return (units * F.lit(Decimal(1).scaleb(-scale))).try_cast(f"decimal(18,{scale})")


def calendar(spark: SparkSession, sf_dir: str) -> list[dt.date]:
    """The month ends of all orders, in order: from their date column alone."""
    months = table(spark, sf_dir, "orders").select(F.last_day(F.to_date("o_orderdate")).alias("p")).distinct()
    return sorted(r["p"] for r in months.collect() if r["p"] is not None)


def complete(spark: SparkSession, sf_dir: str) -> list[dt.date]:
    """The month ends of the calendar but the last LAG, whose orders are still coming in."""
    days = calendar(spark, sf_dir)
    return days[: len(days) - LAG] if len(days) > LAG else days


def latest(spark: SparkSession, sf_dir: str) -> tuple[dt.date | None, dt.date | None]:
    """The last complete month of the orders, and the one nearest to a year before; None without orders."""
    days = complete(spark, sf_dir)
    return (days[-1], per.prior(days, days[-1], "yoy")) if days else (None, None)


def ordered_between(orders: DataFrame, spans: list[tuple[dt.date | None, dt.date | None]]) -> DataFrame:
    """Orders of the given spans of days (first and last, either open): comparisons of the stored column with literals, which reach the scan."""
    at = lambda d: F.lit(d.isoformat()).cast(orders.schema["o_orderdate"].dataType)
    day = F.col("o_orderdate")
    one = lambda lo, hi: (F.lit(True) if lo is None else day >= at(lo)) & (F.lit(True) if hi is None else day < at(hi + dt.timedelta(1)))
    return orders.filter(reduce(or_, [one(lo, hi) for lo, hi in spans], F.lit(False)))


def sales(spark: SparkSession, sf_dir: str, *dims: str, months: list[dt.date | None] | tuple | None = None, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """One row a line item: dates, order and line keys, measures, and the dimensions named. Only the tables that they need are joined.

    months (any days of them) or since and until (days included) keep the orders of these dates alone, at the scan.
    """
    orders = table(spark, sf_dir, "orders")
    if months is not None:
        orders = ordered_between(orders, sorted({(m.replace(day=1), (m.replace(day=1) + dt.timedelta(31)).replace(day=1) - dt.timedelta(1)) for m in months if m is not None}))
    elif since is not None or until is not None:
        orders = ordered_between(orders, [(since, until)])
    asked = set(dims)
    df = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if asked & (GEO | CUSTOMER):
        df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if asked & GEO:
        df = df.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    if asked & PRODUCT:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if asked & MAKER:
        df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    names = {
        "region": "r_name", "nation": "n_name", "customer": "c_custkey", "segment": "c_mktsegment", "priority": "o_orderpriority", "flag": "l_returnflag", "brand": "p_brand", "ptype": "p_type",
        "part": "l_partkey", "supplier": "l_suppkey", "maker": "s_name", "order_id": "o_orderkey", "line": "l_linenumber", "discount": "l_discount",
    }
    day = F.to_date("o_orderdate")
    return df.select(
        day.alias("order_date"),
        F.to_date("l_shipdate").alias("ship_date"),
        F.last_day(day).alias("period"),
        exact(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"),
        exact(F.col("l_quantity"), 2).alias("quantity"),
        *[F.col(names[d]).alias(d) for d in dims],
    )


#: The same fact with every dimension, for DuckDB; and its last complete month, with those a year and a month before.
SALES_SQL = """sales AS (
    SELECT CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date, last_day(CAST(o_orderdate AS DATE)) AS period,
           CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS revenue, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
           r_name AS region, n_name AS nation, c_custkey AS customer, c_mktsegment AS segment, o_orderpriority AS priority, l_returnflag AS flag,
           p_brand AS brand, p_type AS ptype, l_partkey AS part, l_suppkey AS supplier, o_orderkey AS order_id, l_linenumber AS line, l_discount AS discount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
    lately AS (SELECT now, last_day(CAST(now - INTERVAL 12 MONTH AS DATE)) AS year_ago, last_day(CAST(now - INTERVAL 1 MONTH AS DATE)) AS month_ago FROM (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS now FROM orders ORDER BY 1 DESC LIMIT 1 OFFSET 1))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily events: the date, the type as metric, the user as entity, the value."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("metric"), "user_id", exact(F.col("value"), 4).alias("value"))


EVENTS_SQL = """ev AS (SELECT CAST(ts AS DATE) AS day, event_type AS metric, user_id, CAST(value AS DECIMAL(18,4)) AS value FROM events)"""
