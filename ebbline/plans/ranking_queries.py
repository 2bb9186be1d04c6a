"""Queries of joins, ranking and set operations (J, W, U)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import periods as per
from ..operators import ranking, series
from ..sources.sinks import kept
from .catalog import query
from .facts import EVENTS_SQL, SALES_SQL, events, latest, sales, table

C = F.col
W = f"WITH {SALES_SQL}"
D = lambda c, n=None, k=6: F.round(C(c).cast("double"), k).alias(n or c)


def day(text: str):
    return F.lit(text).cast("date")


def _pair(spark, sf, *key):
    """Current and prior sums of a key in one pass over the two periods: their outer join, without joining."""
    now, then = latest(spark, sf)
    both = sales(spark, sf, *key, months=(now, then))
    return both.groupBy(*key).agg(per.at(now, "revenue").alias("current"), per.at(then, "revenue").alias("prior"))


def _pair_sql(key: str) -> str:
    return f"{W}, c AS (SELECT {key}, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE period = (SELECT now FROM lately) GROUP BY ALL), p AS (SELECT {key}, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE period = (SELECT year_ago FROM lately) GROUP BY ALL) SELECT {key}, coalesce(c.v, 0) AS current, coalesce(p.v, 0) AS prior FROM c FULL JOIN p USING ({key})"


def _outer(name: str, *key: str):
    @query(name, _pair_sql(", ".join(key)))
    def run(spark, sf):
        return _pair(spark, sf, *key)


_outer("j01_current_prior", "nation")
_outer("j02_dimension_outer", "brand")
_outer("j03_segment_outer", "segment")
_outer("j04_cell_outer", "region", "segment")

SLICE = "t AS (SELECT region, sum(revenue) AS v FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3), b AS (SELECT region, nation FROM (SELECT region, nation, row_number() OVER (PARTITION BY region ORDER BY sum(revenue) DESC, nation) AS r FROM sales SEMI JOIN t USING (region) GROUP BY 1, 2) WHERE r <= 2)"


@query("j05_slice_join", f"{W}, {SLICE} SELECT region, nation, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS quantity FROM sales SEMI JOIN b USING (region, nation) GROUP BY 1, 2")
def j05(spark, sf):
    df = sales(spark, sf, "region", "nation")
    keep = ranking.ranked_slice(df, "revenue", ("region", "nation"), (3, 2))
    return ranking.sliced(df, keep).groupBy("region", "nation").agg(F.count("*").alias("n"), F.sum("quantity").cast("double").alias("quantity"))


@query("j06_exists", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY 1")
def j06(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 200000").select(C("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("j07_keep_list", f"{W}, t AS (SELECT region, nation, sum(revenue) AS v FROM sales GROUP BY 1, 2), k AS (SELECT region, nation FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY v DESC, nation) AS r FROM t) WHERE r <= 2) SELECT region, nation, CAST(v AS DOUBLE) AS revenue FROM t SEMI JOIN k USING (region, nation)")
def j07(spark, sf):
    t = sales(spark, sf, "region", "nation").groupBy("region", "nation").agg(F.sum("revenue").alias("revenue"))
    return ranking.tier_filtered(t, ranking.Tier("nation", "top_n", 2, "region"), "revenue").select("region", "nation", D("revenue"))


@query("j08_material_join", f"{W}, s AS (SELECT period, brand, sum(revenue) AS v FROM sales GROUP BY 1, 2), k AS (SELECT period, brand, CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY period) AS DOUBLE) AS sh, v FROM s) SELECT period, brand, CAST(v AS DOUBLE) AS revenue FROM k WHERE sh >= 0.05", dates="period")
def j08(spark, sf):
    from ..operators.rollup import material

    s = sales(spark, sf, "brand").groupBy("period", "brand").agg(F.sum("revenue").alias("revenue"))
    return material(s, "brand", "revenue", 0.05).select("period", "brand", D("revenue"))


MEMBERS = f"c AS (SELECT DISTINCT customer FROM sales WHERE period = (SELECT now FROM lately)), p AS (SELECT DISTINCT customer FROM sales WHERE period = (SELECT year_ago FROM lately))"


@query("j09_entity_sets", f"{W}, {MEMBERS} SELECT 'new' AS kind, customer FROM (SELECT * FROM c EXCEPT SELECT * FROM p) UNION ALL SELECT 'lost', customer FROM (SELECT * FROM p EXCEPT SELECT * FROM c) UNION ALL SELECT 'same', customer FROM (SELECT * FROM c INTERSECT SELECT * FROM p)")
def j09(spark, sf):
    both = latest(spark, sf)
    return ranking.entity_sets(sales(spark, sf, "customer", months=both), "customer", *both)


@query("j10_nearest_period", """WITH p AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), t AS (SELECT DISTINCT CAST(make_date(y, m, 15) AS DATE) AS target FROM range(1994, 2003) AS r(y), range(1, 13) AS s(m))
    SELECT target, arg_min(d, (abs(d - target), d)) AS period FROM t LEFT JOIN p ON abs(d - target) <= 7 GROUP BY 1""", dates="target period")
def j10(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("period"))
    targets = spark.range(1994 * 12, 2003 * 12).select(F.make_date((C("id") / 12).cast("int"), (C("id") % 12 + 1).cast("int"), F.lit(15)).alias("target"))
    return per.nearest(days, targets, 7)


CALENDAR = "cal AS (SELECT * FROM (VALUES ('NATION_5', '2001-07-31'), ('NATION_7', ''), ('NATION_9', '1999-01-31')) AS cal(item, period))"


@query("j11_event_calendar", f"{W}, {CALENDAR} SELECT nation, period, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE EXISTS (SELECT 1 FROM cal WHERE nation = item AND (cal.period = '' OR CAST(cal.period AS VARCHAR) = CAST(sales.period AS VARCHAR))) GROUP BY 1, 2", dates="period")
def j11(spark, sf):
    n = table(spark, sf, "nation").filter(C("n_name").isin("NATION_5", "NATION_7", "NATION_9"))
    when = F.when(C("n_name") == "NATION_5", "2001-07-31").when(C("n_name") == "NATION_9", "1999-01-31").otherwise("")
    calendar = n.select(C("n_name").alias("item"), when.alias("event_period"))
    cells = sales(spark, sf, "nation").groupBy("nation", "period").agg(F.sum("revenue").cast("double").alias("revenue"))
    hit = (C("nation") == C("item")) & ((F.coalesce(C("event_period"), F.lit("")) == "") | (C("event_period") == C("period").cast("string")))
    return cells.join(calendar, hit, "left_semi")


@query("j12_wildcard_rules", f"{W}, c AS (SELECT ptype, brand, period, count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1, 2, 3) SELECT ptype, brand, period, n FROM c WHERE ((ptype LIKE 'S%' OR ptype LIKE '%L') AND brand LIKE 'Brand#1_' AND period IN (DATE '1996-01-31', DATE '2001-07-31') AND least(v / 1e6, 1) < 0.5) OR (brand LIKE '%25' AND least(v / 1e6, 1) < 0.01)", dates="period")
def j12(spark, sf):
    """Cells that a rule fits: by any of its item patterns, its target patterns, its periods, and a severity below its limit."""
    rules = spark.createDataFrame([(["s*", "*l"], ["brand#1?"], ["1996-01-31", "2001-07-31"], 0.5), (["*"], ["*25"], [], 0.01)], al.RULES)
    cells = sales(spark, sf, "ptype", "brand").groupBy("ptype", "brand", "period").agg(F.count("*").alias("n"), F.sum("revenue").cast("double").alias("v"))
    return al.fitting(cells, rules, ("ptype", "brand", "period", "n"), "ptype", "brand", "period", F.least(C("v") / 1e6, F.lit(1.0)))


@query("j13_feedback_lookup", "SELECT o_orderstatus, count(*) AS n FROM orders LEFT JOIN (SELECT event_id, event_type FROM events) ON o_orderkey = event_id WHERE event_type IS NULL OR event_type NOT IN ('error', 'logout') GROUP BY 1")
def j13(spark, sf):
    feedback = table(spark, sf, "events").select(C("event_id").alias("o_orderkey"), C("event_type").alias("tag"))
    kept = table(spark, sf, "orders").join(feedback, "o_orderkey", "left").filter(C("tag").isNull() | ~C("tag").isin("error", "logout"))
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("j14_metadata_lookup", "WITH m AS (SELECT c_nationkey, min(c_custkey) AS first_customer, arg_min(c_mktsegment, c_custkey) AS segment FROM customer GROUP BY 1) SELECT n_name, first_customer, segment FROM nation LEFT JOIN m ON n_nationkey = c_nationkey")
def j14(spark, sf):
    first = table(spark, sf, "customer").groupBy(C("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("first_customer"), F.min_by("c_mktsegment", "c_custkey").alias("segment"))
    return table(spark, sf, "nation").join(first, "n_nationkey", "left").select("n_name", "first_customer", "segment")


@query("j15_detail_attach", f"{W} SELECT nation, CAST(sum(revenue) AS DOUBLE) AS revenue, round(CAST(sum(revenue) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE), 6) AS price FROM sales WHERE period = (SELECT now FROM lately) GROUP BY 1")
def j15(spark, sf):
    df = sales(spark, sf, "nation", months=latest(spark, sf)[:1])
    drivers = df.groupBy("nation").agg(F.sum("revenue").cast("double").alias("revenue"))
    detail = df.groupBy("nation").agg(F.round(F.sum("revenue").cast("double") / F.sum("quantity").cast("double"), 6).alias("price"))
    return drivers.join(detail, "nation", "left")


@query("j16_similar_history", f"""{W}, m AS (SELECT brand, period, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE period <= (SELECT now FROM lately) GROUP BY 1, 2), d AS (SELECT *, v - lag(v) OVER (PARTITION BY brand ORDER BY period) AS delta FROM m),
    n AS (SELECT brand, delta FROM d WHERE period = (SELECT now FROM lately)), h AS (SELECT d.brand, d.period, d.delta, n.delta AS now, row_number() OVER (PARTITION BY d.brand ORDER BY d.period DESC) AS r FROM d JOIN n USING (brand) WHERE d.period < (SELECT now FROM lately)),
    f AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY period DESC) AS k FROM h WHERE r <= 3 AND delta / nullif(now, 0) BETWEEN 0.5 AND 2.0) SELECT brand, period, round(delta, 4) AS delta FROM f WHERE k <= 2""", dates="period")
def j16(spark, sf):
    now, _ = latest(spark, sf)
    m = sales(spark, sf, "brand", until=now).groupBy("brand", "period").agg(F.sum("revenue").cast("double").alias("v"))
    d = m.withColumn("delta", C("v") - F.lag("v").over(Window.partitionBy("brand").orderBy("period")))
    return ranking.similar_history(d, "brand", "delta", now).select("brand", "period", D("delta", k=4))


@query("w01_ranked_slice_2", f"{W}, {SLICE} SELECT * FROM b")
def w01(spark, sf):
    return ranking.ranked_slice(sales(spark, sf, "region", "nation"), "revenue", ("region", "nation"), (3, 2))


SLICE3 = SLICE + ", s3 AS (SELECT region, nation, segment FROM (SELECT region, nation, segment, row_number() OVER (PARTITION BY region, nation ORDER BY sum(revenue) DESC, segment) AS r FROM sales SEMI JOIN b USING (region, nation) GROUP BY 1, 2, 3) WHERE r <= 2)"


@query("w02_ranked_slice_3", f"{W}, {SLICE3} SELECT * FROM s3")
def w02(spark, sf):
    return ranking.ranked_slice(sales(spark, sf, "region", "nation", "segment"), "revenue", ("region", "nation", "segment"), (3, 2, 2))


@query("w03_ranked_aggregation", f"{W}, {SLICE} SELECT period, region, nation, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales SEMI JOIN b USING (region, nation) GROUP BY 1, 2, 3", dates="period")
def w03(spark, sf):
    df = sales(spark, sf, "region", "nation").groupBy("period", "region", "nation").agg(F.sum("revenue").alias("revenue"))
    return ranking.sliced(df, ranking.ranked_slice(df, "revenue", ("region", "nation"), (3, 2))).select("period", "region", "nation", D("revenue"))


@query("w04_slice_diagnostics", f"{W}, {SLICE} SELECT (SELECT count(DISTINCT region) FROM sales) AS parents, (SELECT count(DISTINCT region) FROM b) AS slots_used, (SELECT count(*) FROM b) AS slice_size")
def w04(spark, sf):
    df = sales(spark, sf, "region", "nation").groupBy("region", "nation").agg(F.sum("revenue").alias("revenue"))
    keep = ranking.ranked_slice(df, "revenue", ("region", "nation"), (3, 2))
    return df.agg(F.count_distinct("region").alias("parents")).join(keep.agg(F.count_distinct("region").alias("slots_used"), F.count("*").alias("slice_size")))


@query("w05_tier_top_n", f"{W}, t AS (SELECT region, nation, sum(abs(revenue)) AS v FROM sales GROUP BY 1, 2) SELECT region, nation FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY v DESC, nation) AS r FROM t) WHERE r <= 2")
def w05(spark, sf):
    tier = ranking.parse_tiers("nation:top_n:2@region")[0]
    return ranking.tier_keys(sales(spark, sf, "region", "nation"), tier, "revenue")


@query("w06_tier_top_pct", f"{W}, t AS (SELECT brand, sum(abs(revenue)) AS v FROM sales GROUP BY 1), c AS (SELECT brand, coalesce(sum(v) OVER (ORDER BY v DESC, brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(v) OVER () AS total FROM t) SELECT brand FROM c WHERE b < 0.8 * total OR total = 0")
def w06(spark, sf):
    return ranking.tier_keys(sales(spark, sf, "brand"), ranking.Tier("brand", "top_pct", 80), "revenue")


RANKED = f"{W}, d AS (SELECT nation AS item, CAST(sum(CASE WHEN period = (SELECT now FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) - CAST(sum(CASE WHEN period = (SELECT year_ago FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS variance FROM sales WHERE period IN ((SELECT now FROM lately), (SELECT year_ago FROM lately)) GROUP BY 1)"


@query("w07_variance_rank", f"{RANKED} SELECT item, round(variance, 4) AS variance, row_number() OVER (ORDER BY abs(variance) DESC, item) AS rank, round(100 * sum(abs(variance)) OVER (ORDER BY abs(variance) DESC, item ROWS UNBOUNDED PRECEDING) / sum(abs(variance)) OVER (), 6) AS cumulative_pct FROM d")
def w07(spark, sf):
    d = _pair(spark, sf, "nation").select(C("nation").alias("item"), (C("current") - C("prior")).alias("variance"))
    return ranking.with_rank(d, "variance", "item").select("item", D("variance", k=4), C("rank"), D("cumulative_pct"))


@query("w08_top_k", f"{RANKED} SELECT item, round(variance, 4) AS variance FROM d ORDER BY abs(variance) DESC, item LIMIT 10")
def w08(spark, sf):
    d = _pair(spark, sf, "nation").select(C("nation").alias("item"), (C("current") - C("prior")).alias("variance"))
    return d.orderBy(F.desc(F.abs("variance")), "item").limit(10).select("item", D("variance", k=4))


SERIES = f"{W}, m AS (SELECT brand AS item, period, CAST(sum(revenue) AS DOUBLE) AS value FROM sales GROUP BY 1, 2)"


def _monthly(spark, sf, dim="brand"):
    return sales(spark, sf, dim).groupBy(C(dim).alias("item"), "period").agg(F.sum("revenue").cast("double").alias("value"))


@query("w09_rolling_average", f"{SERIES}, r AS (SELECT *, avg(value) OVER (PARTITION BY item ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a FROM m) SELECT item, period, round(a, 4) AS rolling_avg, round(100 * (value - a) / abs(a), 6) AS vs_rolling_avg_pct FROM r", dates="period")
def w09(spark, sf):
    return series.rolling_before(_monthly(spark, sf)).select("item", "period", D("rolling_avg", k=4), D("vs_rolling_avg_pct"))


@query("w10_period_difference", f"{SERIES} SELECT item, period, round(value - lag(value) OVER (PARTITION BY item ORDER BY period), 4) AS diff FROM m", dates="period")
def w10(spark, sf):
    return _monthly(spark, sf).select("item", "period", F.round(C("value") - per.lagged("value", ("item",)), 4).alias("diff"))


RUNNING = f"{W}, m AS (SELECT region AS item, period, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1, 2), u AS (SELECT item, period, v AS value FROM m UNION ALL SELECT item || ' total', period, sum(v) OVER (PARTITION BY item ORDER BY period) FROM m)"


def _running(spark, sf):
    m = _monthly(spark, sf, "region")
    total = m.select(F.concat("item", F.lit(" total")).alias("item"), "period", F.sum("value").over(Window.partitionBy("item").orderBy("period")).alias("value"))
    return m.unionByName(total)


@query("w11_cumulative_detection", f"""{RUNNING}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY item ORDER BY period) AS s FROM u), p AS (SELECT item, count(*) AS n, max(value) - min(value) AS r, avg(CASE WHEN s > 0 THEN 1.0 WHEN s IS NOT NULL THEN 0 END) AS up, greatest(1e-6, 0.5 * quantile_cont(abs(s), 0.1)) AS t FROM d GROUP BY 1),
    q AS (SELECT d.item, avg(CASE WHEN s >= -t THEN 1.0 WHEN s IS NOT NULL THEN 0 END) AS ok FROM d JOIN p USING (item) GROUP BY 1) SELECT item, n >= 6 AND up >= 0.6 AND r > 0 AND ok >= 0.85 AS is_cumulative FROM p JOIN q USING (item)""")
def w11(spark, sf):
    return series.cumulative_items(_running(spark, sf))


@query("w12_decumulate", f"{RUNNING} SELECT item, period, round(greatest(coalesce(value - lag(value) OVER (PARTITION BY item ORDER BY period), value), 0), 2) AS value FROM u WHERE item LIKE '% total'", dates="period")
def w12(spark, sf):
    return series.decumulated(_running(spark, sf).filter(C("item").endswith(" total"))).select("item", "period", D("value", k=2))


@query("w13_smoothing", f"""WITH {EVENTS_SQL}, d AS (SELECT metric AS item, day AS period, CAST(sum(value) AS DOUBLE) AS value FROM ev GROUP BY 1, 2), s AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(value) OVER w END AS m FROM d WINDOW w AS (PARTITION BY item ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT item, period, round(coalesce(m, first_value(m IGNORE NULLS) OVER (PARTITION BY item ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS smoothed FROM s""", dates="period")
def w13(spark, sf):
    d = events(spark, sf).groupBy(C("metric").alias("item"), C("day").alias("period")).agg(F.sum("value").cast("double").alias("value"))
    return series.smoothed(d).select("item", "period", D("smoothed"))


@query("w14_top_entities", f"{W}, t AS (SELECT customer, CAST(sum(revenue) AS DOUBLE) AS total, count(DISTINCT order_id) AS orders FROM sales GROUP BY 1) SELECT customer, total, orders, round(total / orders, 4) AS per_order, round(100 * total / (SELECT sum(total) FROM t), 9) AS share_pct FROM t ORDER BY total DESC, customer LIMIT 20")
def w14(spark, sf):
    out = ranking.top_entities(sales(spark, sf, "customer", "order_id"), "customer", "order_id", "revenue")
    return out.select("customer", "total", "orders", D("per_order", k=4), D("share_pct", k=9))


@query("w15_major_shares", f"{W}, t AS (SELECT nation, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1) SELECT nation, round(v / (SELECT sum(v) FROM t), 9) AS share, v / (SELECT sum(v) FROM t) >= 0.05 AS is_major FROM t")
def w15(spark, sf):
    """Every nation's share, and which ones hold 5 % or more."""
    return ranking.major_shares(sales(spark, sf, "nation"), "nation", "revenue").select("nation", D("share", k=9), "is_major")


@query("w16_detail_rows", f"{W} SELECT order_id, line, CAST(revenue AS DOUBLE) AS revenue FROM sales WHERE period = (SELECT now FROM lately) AND region = 'ASIA' ORDER BY revenue DESC, order_id, line LIMIT 1000")
def w16(spark, sf):
    df = sales(spark, sf, "region", "order_id", "line", months=latest(spark, sf)[:1]).filter(C("region") == "ASIA")
    return df.orderBy(F.desc("revenue"), "order_id", "line").limit(1000).select("order_id", "line", C("revenue").cast("double"))


@query("w17_persistent_movers", f"{SERIES}, d AS (SELECT item, period, abs(value - lag(value) OVER (PARTITION BY item ORDER BY period)) AS s FROM m), r AS (SELECT item, row_number() OVER (PARTITION BY period ORDER BY s DESC, item) AS r FROM d WHERE s IS NOT NULL) SELECT item, count(*) AS times, (SELECT count(DISTINCT period) - 1 FROM m) AS periods, count(*) > 0.5 * (SELECT count(DISTINCT period) - 1 FROM m) AS persistent FROM r WHERE r <= 5 GROUP BY 1")
def w17(spark, sf):
    """How often each brand is among the five largest moves, and whether in over half of the periods."""
    return ranking.persistent_movers(kept(_monthly(spark, sf), "movers")).select("item", "times", "periods", "persistent")


@query("w18_scope_entities", f"{W}, x AS (SELECT nation, segment, CAST(sum(CASE WHEN period = (SELECT now FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS c, CAST(sum(CASE WHEN period = (SELECT year_ago FROM lately) THEN revenue ELSE 0 END) AS DOUBLE) AS p FROM sales WHERE period IN ((SELECT now FROM lately), (SELECT year_ago FROM lately)) GROUP BY 1, 2) SELECT nation, round(sum(abs(c - p)), 4) AS moved, round(max(abs((c - p) / nullif(p, 0))) * 100, 6) AS most_pct FROM x GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1")
def w18(spark, sf):
    return ranking.moved_entities(_pair(spark, sf, "nation", "segment"), "nation").select("nation", D("moved", k=4), D("most_pct"))


@query("w19_rank_of_parent", f"{W}, t AS (SELECT nation, sum(revenue) AS v FROM sales WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1) SELECT * FROM (SELECT nation, CAST(v AS DOUBLE) AS total, row_number() OVER (ORDER BY v DESC NULLS LAST, nation) AS rank FROM t) WHERE nation = 'NATION_5'")
def w19(spark, sf):
    df = sales(spark, sf, "nation", since=dt.date(2000, 1, 1), until=dt.date(2000, 12, 31))
    return ranking.rank_of(df, "nation", "revenue", "NATION_5").select("nation", D("total"), "rank")


@query("u01_union_metrics", f"{W} SELECT 'revenue' AS metric, period, CAST(sum(revenue) AS DOUBLE) AS value FROM sales GROUP BY 2 UNION ALL SELECT 'quantity', period, CAST(sum(quantity) AS DOUBLE) FROM sales GROUP BY 2", dates="period")
def u01(spark, sf):
    t = sales(spark, sf).groupBy("period").agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("double").alias("quantity"))
    one = lambda m: t.select(F.lit(m).alias("metric"), "period", C(m).alias("value"))
    return one("revenue").unionByName(one("quantity"))


@query("u02_net_new", f"{RANKED}, f AS (SELECT item FROM d ORDER BY abs(variance) DESC, item LIMIT 5) SELECT item, round(variance, 4) AS variance FROM d WHERE item NOT IN (SELECT item FROM f)")
def u02(spark, sf):
    d = _pair(spark, sf, "nation").select(C("nation").alias("item"), (C("current") - C("prior")).alias("variance"))
    found = d.orderBy(F.desc(F.abs("variance")), "item").limit(5).select("item")
    return d.join(found, "item", "left_anti").select("item", D("variance", k=4))


@query("u03_entity_intersection", f"{W}, {MEMBERS} SELECT customer FROM c INTERSECT SELECT customer FROM p")
def u03(spark, sf):
    members = lambda p: sales(spark, sf, "customer", months=(p,)).select("customer")
    now, then = latest(spark, sf)
    return members(now).intersect(members(then))


@query("u04_best_signals", f"{W}, s AS (SELECT nation AS title, segment AS metric, priority AS source, brand, CAST(sum(revenue) AS DOUBLE) AS score FROM sales GROUP BY 1, 2, 3, 4) SELECT title, metric, source, max(score) AS score FROM s GROUP BY 1, 2, 3")
def u04(spark, sf):
    s = sales(spark, sf, "nation", "segment", "priority", "brand").groupBy(C("nation").alias("title"), C("segment").alias("metric"), C("priority").alias("source"), "brand").agg(F.sum("revenue").cast("double").alias("score"))
    return ranking.first_of(s, ("title", "metric", "source"), F.desc("score"), C("brand")).drop("brand")
