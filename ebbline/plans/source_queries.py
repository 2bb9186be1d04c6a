"""Queries of sources, sinks and filters (S, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as flt
from ..sources import loaders, sinks
from .catalog import query
from .facts import EVENTS_SQL, SALES_SQL, events, sales, table

C = F.col


@query("s01_config_load", f"WITH {EVENTS_SQL} SELECT day AS period, metric, CAST(sum(value) AS DOUBLE) AS value FROM ev WHERE metric IN ('click', 'purchase', 'view') GROUP BY ALL", dates="period")
def s01(spark, sf):
    text = events(spark, sf).select(C("day").cast("string").alias("raw"), C("metric"), C("value").cast("string").alias("amount"))
    config = loaders.LoaderConfig(cleaning={"amount": loaders.Cleaning()}, date=("raw", "yyyy-MM-dd", "period"), rename={"amount": "value"}, output=("period", "metric", "value"))
    out = loaders.load(text, config, metrics=["Click ", "PURCHASE", "view"])
    return out.groupBy("period", "metric").agg(F.sum(C("value").cast("decimal(18,4)")).cast("double").alias("value"))


@query("s02_csv_scan", "SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def s02(spark, sf):
    path = sinks.shared_path(spark, "orders-csv")
    sinks.export_csv(table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), path)
    df = loaders.read_text(spark, path)
    return df.groupBy(C("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.sum(C("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def _wide(spark, sf):
    df = table(spark, sf, "orders").join(table(spark, sf, "customer"), C("o_custkey") == C("c_custkey")).join(table(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey"))
    years = [str(y) for y in range(1995, 2002)]
    return df.withColumn("y", F.year("o_orderdate").cast("string")).groupBy("n_name").pivot("y", years).agg(F.sum(C("o_totalprice").cast("decimal(18,2)")))


LONG_SQL = "SELECT n_name, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey {} GROUP BY ALL"


@query("s03_unpivot", LONG_SQL.format(""))
def s03(spark, sf):
    return loaders.unpivot(_wide(spark, sf), ("n_name",), "year", "value").filter("value IS NOT NULL").withColumn("value", C("value").cast("double"))


@query("s04_partial_periods", LONG_SQL.format("WHERE year(o_orderdate) <> 2001"))
def s04(spark, sf):
    long = loaders.unpivot(_wide(spark, sf), ("n_name",), "year", "value").filter("value IS NOT NULL").withColumn("value", C("value").cast("double"))
    return loaders.without_periods(long, "year", ("2001",))


@query("s05_value_cleaning", "SELECT o_orderpriority AS priority, count(*) AS rows, count(*) FILTER (o_orderkey % 7 <> 0) AS numbers, CAST(sum(CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM orders GROUP BY 1")
def s05(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderpriority", F.when(C("o_orderkey") % 7 == 0, F.lit(" - ")).otherwise(F.concat(F.lit("$"), F.format_number(C("o_totalprice"), 2))).alias("raw"))
    value = loaders.cleaned(C("raw"), loaders.Cleaning())
    return raw.withColumn("value", value).groupBy(C("o_orderpriority").alias("priority")).agg(F.count("*").alias("rows"), F.count("value").alias("numbers"), F.sum(C("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("s06_date_parsing", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1", dates="day")
def s06(spark, sf):
    raw = table(spark, sf, "orders").select(F.when(C("o_orderkey") % 11 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("raw"))
    return loaders.parsed_dates(raw, "raw", "dd-MM-yyyy", "day").groupBy("day").agg(F.count("*").alias("n"))


@query("s07_projection", "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def s07(spark, sf):
    return loaders.projected(table(spark, sf, "customer"), {"c_custkey": "id", "c_mktsegment": "segment", "c_acctbal": "balance"}, ("id", "segment", "balance"), ("segment", "id"))


@query("s08_pushed_aggregate", "SELECT last_day(CAST(l_shipdate AS DATE)) AS period, l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, avg(l_discount) AS avg_discount, count(DISTINCT l_suppkey) AS n_supplier FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND l_linestatus IN ('F', 'O') GROUP BY ALL", dates="period")
def s08(spark, sf):
    df = table(spark, sf, "lineitem").filter(C("l_shipdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1997-12-31 23:59:59").cast("timestamp")) & C("l_linestatus").isin("F", "O"))
    df = df.select(F.to_date("l_shipdate").alias("day"), "l_returnflag", C("l_quantity").cast("decimal(18,2)").alias("quantity"), C("l_discount").alias("discount"), C("l_suppkey").alias("supplier"))
    return loaders.period_aggregate(df, "day", "monthly", ("l_returnflag",), ("quantity",), ("discount",), ("supplier",)).withColumn("quantity", C("quantity").cast("double"))


#: The types that the fact tables are stored with.
STORED = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


@query("s09_schema_probe", " UNION ALL ".join(f"SELECT '{name}' AS \"table\", (SELECT count(*) FROM {name}) AS rows, c AS \"column\", t AS type FROM (VALUES {', '.join(str(tuple(x.split(' '))) for x in cols.split(', '))}) AS v(c, t)" for name, cols in STORED.items()))
def s09(spark, sf):
    """Columns and types of the fact tables, with the rows that each holds."""
    out = None
    for name in ("lineitem", "orders", "customer", "part", "supplier", "events"):
        df = table(spark, sf, name)
        types = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in loaders.schema_of(df)])
        rows = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.explode(types).alias("f")).select("table", "rows", "f.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s10_bulk_export", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def s10(spark, sf):
    path = sinks.shared_path(spark, "customer-csv")
    sinks.export_csv(table(spark, sf, "customer"), path)
    return loaders.read_text(spark, path).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("s12_weekly_report", f"WITH {EVENTS_SQL} SELECT metric, CAST(day + CAST((7 - isodow(day)) AS INTEGER) AS DATE) AS period, CAST(sum(value) AS DOUBLE) AS value FROM ev GROUP BY 1, 2", dates="period")
def s12(spark, sf):
    from ..functions.dates import week_end_sunday

    weeks = ["1/7/2024", "1/14/2024", "1/21/2024", "1/28/2024", "2/4/2024"]
    wide = events(spark, sf).withColumn("week", F.date_format(week_end_sunday(C("day")), "M/d/yyyy")).groupBy("metric").pivot("week", weeks).agg(F.concat(F.lit("$"), F.format_number(F.sum("value"), 4)))
    path = sinks.shared_path(spark, "weekly-tsv")
    wide.write.option("header", True).option("sep", "\t").option("encoding", "UTF-16").csv(path)
    return loaders.weekly_report(spark, path, ("metric",), known_partial=("12/31/2023",)).select("metric", "period", C("value"))


@query("s13_result_sink", f"WITH {EVENTS_SQL} SELECT metric, day, CAST(sum(value) AS DOUBLE) AS total FROM ev GROUP BY ALL", dates="day")
def s13(spark, sf):
    path = sinks.shared_path(spark, "results-json")
    sinks.commit(events(spark, sf).groupBy("metric", "day").agg(F.sum("value").cast("double").alias("total")), path, form="json", by=("metric",))
    return sinks.committed(spark, path).select("metric", "day", "total")


@query("s15_distinct_values", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY 1 LIMIT 500")
def s15(spark, sf):
    return loaders.distinct_values(table(spark, sf, "part"), "p_brand")


# Filters. All run over the sales fact and report counts per region.
def _count(df):
    return df.groupBy("region").agg(F.count("*").alias("n"), F.sum("revenue").cast("double").alias("revenue"))


def _sql(where: str) -> str:
    return f"WITH {SALES_SQL} SELECT region, count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE {where} GROUP BY 1"


@query("f01_equality", _sql("segment = 'BUILDING'"))
def f01(spark, sf):
    return _count(sales(spark, sf, "region", "segment").filter(flt.same_text(C("segment"), "  Building ")))


@query("f02_in_set", _sql("segment IN ('BUILDING', 'MACHINERY') AND priority IN ('1-URGENT')"))
def f02(spark, sf):
    return _count(flt.in_set(sales(spark, sf, "region", "segment", "priority"), {"segment": ["building", " Machinery"], "priority": "1-urgent", "unknown": "x", "flag": []}))


@query("f03_metric_filter", "WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT 'contains' AS kind, event_type, n FROM e WHERE contains(event_type, 'c') UNION ALL SELECT 'list', event_type, n FROM e WHERE event_type IN ('click', 'view')")
def f03(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return flt.metric_filter(e, "event_type", "C").select(F.lit("contains").alias("kind"), "*").unionByName(flt.metric_filter(e, "event_type", "click, view").select(F.lit("list").alias("kind"), "*"))


@query("f05_empty_safe", _sql("true"))
def f05(spark, sf):
    return _count(flt.unless_empty(sales(spark, sf, "region", "segment"), C("segment") == "NO SUCH SEGMENT"))


@query("f06_hierarchy_values", _sql("nation IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 2, 3))"))
def f06(spark, sf):
    df = sales(spark, sf, "region", "nation")
    wanted = table(spark, sf, "nation").filter(C("n_nationkey").isin(1, 2, 3)).select(C("n_name").alias("nation"))
    return _count(df.join(wanted, "nation", "left_semi"))


@query("f07_date_range", _sql("order_date BETWEEN DATE '1996-03-01' AND DATE '1996-09-30'"))
def f07(spark, sf):
    return _count(sales(spark, sf, "region").filter(flt.between_dates(C("order_date"), "1996-03-01", "1996-09-30")))


@query("f08_month_range", _sql("order_date BETWEEN DATE '1996-11-01' AND DATE '1998-02-28'"))
def f08(spark, sf):
    first, last = flt.month_span((1996, 11), (1998, 2))  # the same as days, which reach the scan
    return _count(sales(spark, sf, "region", since=first, until=last).filter(flt.between_months(F.year("order_date"), F.month("order_date"), (1996, 11), (1998, 2))))


@query("f09_physical_values", _sql("flag IN ('A', 'R') AND priority = '2-HIGH'"))
def f09(spark, sf):
    return _count(sales(spark, sf, "region", "flag", "priority").filter(C("flag").isin("A", "R") & (C("priority") == "2-HIGH")))


@query("f10_second_date_filter", _sql("ship_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'"))
def f10(spark, sf):
    return _count(sales(spark, sf, "region").withColumnRenamed("ship_date", "shipped").filter(F.to_date("shipped").between("1997-01-01", "1997-06-30")))


def _days(spark, sf):
    """Dates and months of the orders, from their date column alone."""
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("order_date")).distinct().withColumn("period", F.last_day("order_date"))


@query("f11_query_window", f"WITH {SALES_SQL}, m AS (SELECT max(CAST(o_orderdate AS DATE)) AS e FROM orders), w(focus, days) AS (VALUES ('default', 730), ('recent', 90), ('weekly', 56), ('monthly', 180), ('yearly', 1095), ('override', 45)) SELECT focus, CAST(e - CAST(days AS INTEGER) AS DATE) AS start, e AS \"end\", (SELECT count(*) FROM sales WHERE order_date BETWEEN e - CAST(days AS INTEGER) AND e) AS rows FROM m, w", dates="start end")
def f11(spark, sf):
    end = table(spark, sf, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    choices = [(None, None, "default"), ("recent", None, "recent"), ("weekly", None, "weekly"), ("monthly", None, "monthly"), ("yearly", None, "yearly"), ("weekly", 45, "override")]
    spans = [(n, flt.first_day(end, f, o)) for f, o, n in choices]
    days = sales(spark, sf, since=min((s for _, s in spans), default=None), until=end).groupBy("order_date").agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(n).alias("focus"), F.lit(s).alias("start"), F.lit(end).alias("end")) for n, s in spans])
    return days.select("n", F.explode(F.filter(each, lambda w: C("order_date") >= w["start"])).alias("w")).groupBy("w.focus", "w.start", "w.end").agg(F.sum("n").alias("rows"))


@query("f12_clamped_end", "SELECT least(DATE '2005-12-31', max(CAST(o_orderdate AS DATE))) AS \"end\", max(CAST(o_orderdate AS DATE)) AS latest FROM orders", dates="end latest")
def f12(spark, sf):
    return flt.clamped_end(_days(spark, sf), "order_date", "2005-12-31")


@query("f13_slice", _sql("brand = 'Brand#12'"))
def f13(spark, sf):
    return _count(sales(spark, sf, "region", "brand").filter(C("brand") == "Brand#12"))


@query("f14_effective_latest", "WITH p AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS period FROM orders) SELECT (SELECT max(period) FROM p) AS lag0, (SELECT period FROM p ORDER BY 1 DESC LIMIT 1 OFFSET 1) AS lag1, (SELECT period FROM p ORDER BY 1 DESC LIMIT 1 OFFSET 3) AS lag3, (SELECT max(period) FROM p) AS lag999", dates="lag0 lag1 lag3 lag999")
def f14(spark, sf):
    from ..functions.dates import distinct_periods

    p = distinct_periods(_days(spark, sf))
    at = lambda lag: F.coalesce(F.max(F.when(C("from_last") == lag + 1, C("period"))), F.max("period")).alias(f"lag{lag}")
    return p.agg(*[at(k) for k in (0, 1, 3, 999)])


@query("f16_blocked_entities", f"WITH {SALES_SQL}, n AS (SELECT nation, count(*) AS c FROM sales GROUP BY 1) SELECT nation, count(*) AS n FROM sales WHERE nation NOT IN (SELECT nation FROM n ORDER BY c, nation LIMIT 3) GROUP BY 1")
def f16(spark, sf):
    df = sales(spark, sf, "nation")
    quiet = df.groupBy("nation").agg(F.count("*").alias("c")).orderBy("c", "nation").limit(3)
    return df.join(quiet, "nation", "left_anti").groupBy("nation").agg(F.count("*").alias("n"))


@query("f17_sign_correction", f"WITH {SALES_SQL} SELECT priority, priority IN ('5-LOW') OR priority LIKE '1%' AS sign_flipped, CAST(sum(CASE WHEN priority IN ('5-LOW') OR priority LIKE '1%' THEN -revenue ELSE revenue END) AS DOUBLE) AS revenue FROM sales GROUP BY 1, 2")
def f17(spark, sf):
    df = flt.sign_corrected(sales(spark, sf, "priority"), "priority", "revenue", ("1",), ("5-LOW",))
    return df.groupBy("priority", "sign_flipped").agg(F.sum("revenue").cast("double").alias("revenue"))


@query("f18_item_classes", "SELECT p_brand, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'house' WHEN p_brand LIKE 'Brand#2%' OR p_brand = 'Brand#31' THEN 'partner' ELSE 'specific_item' END AS class, count(*) AS n FROM part GROUP BY 1, 2")
def f18(spark, sf):
    policy = [("house", ("Brand#1",), ()), ("partner", ("Brand#2",), ("Brand#31",))]
    return table(spark, sf, "part").groupBy("p_brand", flt.classified(C("p_brand"), policy).alias("class")).agg(F.count("*").alias("n"))
