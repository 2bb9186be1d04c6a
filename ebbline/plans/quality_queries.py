"""Queries of data quality and contract inference (Q, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as qa
from .catalog import query
from .facts import SALES_SQL, sales, table

C = F.col
W = f"WITH {SALES_SQL}"


@query("q01_required_columns", "SELECT 'o_margin' AS missing, count(*) AS rows FROM orders")
def q01(spark, sf):
    df = table(spark, sf, "orders")
    gone = qa.missing_columns(df, ("o_orderkey", "o_orderdate", "o_margin"))
    return df.agg(F.lit(",".join(gone)).alias("missing"), F.count("*").alias("rows"))


@query("q02_grain_uniqueness", "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE))")
def q02(spark, sf):
    return qa.duplicate_rows(table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate")), ("o_custkey", "day"))


RAW = "SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d, CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE '$' || CAST(o_totalprice AS VARCHAR) END AS v FROM orders"


def _raw(spark, sf):
    return table(spark, sf, "orders").select(F.when(C("o_orderkey") % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"), F.when(C("o_orderkey") % 17 == 0, "n/a").otherwise(F.concat(F.lit("$"), C("o_totalprice").cast("string"))).alias("v"), "o_totalprice")


@query("q03_time_parseable", f"SELECT count(*) FILTER (try_strptime(d, '%Y-%m-%d') IS NULL) AS unreadable FROM ({RAW})")
def q03(spark, sf):
    return _raw(spark, sf).agg(qa.unreadable_dates(C("d"), "yyyy-MM-dd").alias("unreadable"))


@query("q04_metric_numeric", f"SELECT count(*) FILTER (TRY_CAST(replace(v, '$', '') AS DOUBLE) IS NULL) AS not_numeric FROM ({RAW})")
def q04(spark, sf):
    return _raw(spark, sf).agg(qa.not_numeric(C("v")).alias("not_numeric"))


@query("q05_rollup_integrity", f"{W}, c AS (SELECT region, sum(v) AS children FROM (SELECT region, nation, sum(revenue) AS v FROM sales GROUP BY 1, 2) GROUP BY 1) SELECT region, CAST(sum(revenue) AS DOUBLE) AS parent, abs(CAST(sum(revenue) AS DOUBLE) - CAST(any_value(children) AS DOUBLE)) <= 0.0001 * abs(CAST(sum(revenue) AS DOUBLE)) AS adds_up FROM sales JOIN c USING (region) GROUP BY 1")
def q05(spark, sf):
    lines = sales(spark, sf, "region", "nation")
    children = lines.groupBy("region", "nation").agg(F.sum("revenue").alias("revenue"))
    return qa.rollup_integrity(lines, children, "region", "revenue").select("region", "parent", "adds_up")


@query("q06_row_budget", "SELECT count(*) AS rows, count(*) <= 250000 AS within_budget FROM lineitem")
def q06(spark, sf):
    return qa.row_budget(table(spark, sf, "lineitem"))


@query("i01_date_formats", f"SELECT 'yyyy-MM-dd' AS format, round(avg(CASE WHEN try_strptime(d, '%Y-%m-%d') IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS share, avg(CASE WHEN try_strptime(d, '%Y-%m-%d') IS NOT NULL THEN 1.0 ELSE 0 END) > 0.8 AS is_time FROM ({RAW})")
def i01(spark, sf):
    return qa.best_format(_raw(spark, sf), "d").select("format", F.round("share", 9).alias("share"), "is_time")


@query("i02_numeric_columns", f"SELECT round(avg(CASE WHEN TRY_CAST(replace(v, '$', '') AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS share, min(TRY_CAST(replace(v, '$', '') AS DOUBLE)) AS lo, max(TRY_CAST(replace(v, '$', '') AS DOUBLE)) AS hi, count(*) FILTER (TRY_CAST(replace(v, '$', '') AS DOUBLE) < 0) AS negatives, count(DISTINCT TRY_CAST(replace(v, '$', '') AS DOUBLE)) AS \"distinct\" FROM ({RAW})")
def i02(spark, sf):
    return qa.number_profile(_raw(spark, sf), "v").withColumn("share", F.round("share", 9))


@query("i03_currency_hint", f"SELECT round(avg(CASE WHEN v LIKE '$%' THEN 1.0 ELSE 0 END), 9) AS share, avg(CASE WHEN v LIKE '$%' THEN 1.0 ELSE 0 END) > 0.3 AS is_currency, avg(CASE WHEN v LIKE '%\\%' ESCAPE '\\' THEN 1.0 ELSE 0 END) > 0.3 AS is_percentage FROM ({RAW})")
def i03(spark, sf):
    hints = qa.symbol_hints(C("v"))
    return _raw(spark, sf).agg(F.round(hints["currency"], 9).alias("share"), (hints["currency"] > 0.3).alias("is_currency"), (hints["percentage"] > 0.3).alias("is_percentage"))


@query("i04_ratio_hint", "SELECT 'l_discount' AS \"column\", min(l_discount) >= 0 AND max(l_discount) <= 1.01 OR (min(l_discount) >= 0 AND max(l_discount) <= 100 AND stddev_samp(l_discount) < 30) AS is_ratio FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice) >= 0 AND max(l_extendedprice) <= 1.01 OR (min(l_extendedprice) >= 0 AND max(l_extendedprice) <= 100 AND stddev_samp(l_extendedprice) < 30) FROM lineitem")
def i04(spark, sf):
    one = [F.struct(F.lit(c).alias("column"), qa.ratio_rule(C(c)).alias("is_ratio")) for c in ("l_discount", "l_extendedprice")]
    return table(spark, sf, "lineitem").agg(F.array(*one).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query("i05_identifier_hint", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) > 0.95 * count(*) AND min({c}) >= 0 AND bool_and({c} = floor({c})) AND ({named} OR max({c}) - min({c}) <= 1000) AS is_identifier FROM orders" for c, named in (("o_orderkey", "true"), ("o_custkey", "true"), ("o_totalprice", "false"))))
def i05(spark, sf):
    one = [F.struct(F.lit(c).alias("column"), qa.identifier_rule(C(c), c).alias("is_identifier")) for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    return table(spark, sf, "orders").agg(F.array(*one).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query("i06_categories", "SELECT count(DISTINCT p_type) AS cardinality, array_to_string(list_sort(list(DISTINCT p_type))[1:10], ',') AS samples FROM part")
def i06(spark, sf):
    return qa.categories(table(spark, sf, "part"), "p_type").select("cardinality", F.array_join("samples", ",").alias("samples"))


@query("i07_frequency", f"{W}, d AS (SELECT DISTINCT period FROM sales), g AS (SELECT period - lag(period) OVER (ORDER BY period) AS gap FROM d) SELECT CAST(median(gap) AS DOUBLE) AS gap, 'monthly' AS frequency FROM g")
def i07(spark, sf):
    return qa.frequency(sales(spark, sf), "period")


@query("i08_hierarchy_detection", "SELECT 'nation' AS child, 'region' AS parent, count(DISTINCT n_name) AS children, count(DISTINCT r_name) AS parents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'customer', p, count(DISTINCT c_custkey), CASE p WHEN 'nation' THEN count(DISTINCT n_name) WHEN 'region' THEN count(DISTINCT r_name) ELSE count(DISTINCT c_mktsegment) END FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (VALUES ('nation'), ('region'), ('segment')) AS x(p) GROUP BY p")
def i08(spark, sf):
    df = table(spark, sf, "customer").join(table(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey")).join(table(spark, sf, "region"), C("n_regionkey") == C("r_regionkey"))
    df = df.select(C("r_name").alias("region"), C("n_name").alias("nation"), C("c_custkey").alias("customer"), C("c_mktsegment").alias("segment"))
    return qa.dependencies(df, ("region", "nation", "customer", "segment"))


@query("i10_suggestions", "SELECT round(0.05 * avg(o_totalprice), 4) AS materiality, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) / 30 AS INTEGER) AS months FROM orders")
def i10(spark, sf):
    out = qa.suggestions(table(spark, sf, "orders"), "o_totalprice", "o_orderdate")
    return out.select(F.round("materiality", 4).alias("materiality"), "months")


@query("s14_contract_inference", """SELECT rows, CASE WHEN gap <= 1 THEN 'daily' WHEN gap BETWEEN 5 AND 8 THEN 'weekly' WHEN gap BETWEEN 25 AND 35 THEN 'monthly' WHEN gap BETWEEN 85 AND 100 THEN 'quarterly' WHEN gap BETWEEN 350 AND 380 THEN 'yearly' ELSE 'irregular' END AS frequency, c AS "column", role, hierarchy, level FROM (SELECT count(*) AS rows FROM orders), (SELECT median(g) AS gap FROM (SELECT d - lag(d) OVER (ORDER BY d) AS g FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders))),
    (VALUES ('o_orderkey', 'identifier', '', 0), ('o_orderdate', 'time', '', 0), ('o_totalprice', 'metric', '', 0), ('o_orderpriority', 'dimension', 'by_urgency', 2), ('urgency', 'dimension', 'by_urgency', 1), ('nation', 'dimension', 'by_region', 2), ('region', 'dimension', 'by_region', 1)) AS v(c, role, hierarchy, level)""")
def s14(spark, sf):
    """The role that inference gives each column of a flat table of orders, and the levels that it finds."""
    from ..operators.inference import propose

    df = table(spark, sf, "orders").join(table(spark, sf, "customer"), C("o_custkey") == C("c_custkey")).join(table(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey")).join(table(spark, sf, "region"), C("n_regionkey") == C("r_regionkey"))
    half = F.when(C("o_orderpriority").substr(1, 1) <= "2", "urgent").otherwise("other")
    df = df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_totalprice", "o_orderpriority", half.alias("urgency"), C("n_name").alias("nation"), C("r_name").alias("region"))
    found, roles = propose(df, "orders")
    place = {c: (name, k) for name, levels in found.hierarchies.items() for k, c in enumerate(levels, 1)}
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"), F.lit(place.get(c, ("", 0))[0]).alias("hierarchy"), F.lit(place.get(c, ("", 0))[1]).cast("int").alias("level")) for c, r in roles.items()])
    return df.agg(F.count("*").alias("rows"), F.lit(found.frequency).alias("frequency")).select("rows", "frequency", F.explode(rows).alias("f")).select("rows", "frequency", "f.*")
