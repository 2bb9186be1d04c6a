"""Ranks and running sums within groups of any size."""

import pytest
from pyspark.sql import functions as F

from ebbline.operators import ranking
from ebbline.operators import stats as st
from ebbline.operators import variance as var
from ebbline.operators.ordered import first_of_each, numbered, quantiles


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbered_by_brute_force(spark):
    rows = [(["a", None, "b", "a", "a"][k % 5], k * 7919 % 101, k, None if k % 11 == 0 else float(k % 13)) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, x int, id int, v double")
    for by in ((), ("g",)):
        got = {r.id: r for r in numbered(df.repartition(13), F.desc("x"), F.col("id"), by=by, totals={"total": "v"}, size="n", before="v").collect()}
        groups = {}
        for g, x, i, v in rows:
            groups.setdefault(g if by else 0, []).append((-x, i, v))
        assert len(got) == len(rows)
        for members in groups.values():
            running = 0.0
            for place, (_, i, v) in enumerate(sorted(members, key=lambda m: m[:2]), 1):
                r = got[i]
                assert (r.row, r.n, r.before) == (place, len(members), pytest.approx(running)) and r.total == pytest.approx(sum(m[2] or 0 for m in members))
                running += v or 0.0
    assert numbered(df.filter("false"), F.col("id"), by=("g",)).count() == 0


def test_a_group_of_a_million_is_split(spark):
    """One group of 10^6 entities and a few small ones, over 32 tasks: the rows are those of a plain window, and no task has a third of the large group."""
    n = 1_000_000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(n + 5000).select(F.when(F.col("id") < n, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 10)).alias("g"), "id", F.pmod(F.hash("id"), F.lit(100_003)).alias("x"))
        out = numbered(df, F.desc("x"), F.col("id"), by=("g",), totals={"t": "x"}, before="x")
        spread = out.withColumn("_p", F.spark_partition_id()).filter("g = 'hot'").groupBy("_p").count().agg(F.max("count"), F.count("*")).first()
        assert spread[0] < n / 3 and spread[1] >= 8
        order = "PARTITION BY g ORDER BY x DESC, id"
        plain = f"SELECT id, CAST(row_number() OVER ({order}) AS BIGINT) AS row, coalesce(sum(x) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(x) OVER (PARTITION BY g) AS t FROM d"
        df.createOrReplaceTempView("d")
        assert out.select("id", "row", "before", "t").exceptAll(spark.sql(plain)).count() == 0 and out.count() == n + 5000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_window_holds_a_level_or_group(spark):
    import datetime as dt

    now, then = dt.date(2024, 2, 29), dt.date(2024, 1, 31)
    df = spark.createDataFrame([(now if k % 2 else then, f"r{k % 3}", f"n{k % 17}", float(k * 31 % 97)) for k in range(400)], "period date, region string, nation string, revenue double")
    cells = df.groupBy("region", "nation").agg(F.sum("revenue").alias("value")).withColumn("item", F.col("nation"))
    for out in (
        var.level_statistics(df, ("region", "nation"), "revenue", now, then), ranking.with_rank(cells, "value", "nation", "region"), st.concentration(cells, "region"),
        ranking.tier_keys(df, ranking.Tier("nation", "top_pct", 80, "region"), "revenue"), var.yearly_truth(df.withColumn("d", F.col("period")), "nation", "d", "revenue", 2024),
    ):
        windows = [line for line in _plan(out).split("\n") if "Window [" in line]
        assert windows and all("_range" in w or "sum(_t_" in w or "sum(_n" in w for w in windows), windows  # a range's rows, or cells
    for out in (var.bridge_lists(df, "nation", "revenue", now, then), var.top_share_risk(df, "region", "nation", "revenue"), ranking.tier_keys(df, ranking.Tier("nation", "top_n", 2, "region"), "revenue")):
        assert "WindowGroupLimit" in _plan(out)  # a task keeps the first rows alone


def test_first_of_each(spark):
    df = spark.createDataFrame([("a", 3), ("a", 5), ("a", 5), ("b", 1), (None, 2), (None, 1)], "g string, x int")
    assert sorted((str(r.g), r.x, r["rank"]) for r in first_of_each(df, ("g",), 2, F.desc("x")).collect()) == [("None", 1, 2), ("None", 2, 1), ("a", 5, 1), ("a", 5, 2), ("b", 1, 1)]


def test_nearest_by_brute_force(spark):
    import datetime as dt
    import random

    from ebbline.operators import periods as per

    rnd = random.Random(2)
    at = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    known, asked = [at(rnd.randrange(900)) for _ in range(60)], [at(rnd.randrange(-50, 1000)) for _ in range(300)]
    frame = lambda days, name: spark.createDataFrame([(d,) for d in [*days, None]], f"{name} date").repartition(5)
    out = per.nearest(frame(known, "period"), frame(asked, "target"), 7)
    got = sorted((str(r.target), r.period) for r in out.collect())
    want = []
    for t in asked:
        near = min(known, key=lambda p: (abs((p - t).days), p))
        want.append((str(t), near if abs((near - t).days) <= 7 else None))
    assert got == sorted([*want, ("None", None)], key=str) or sorted(got, key=str) == sorted([*want, ("None", None)], key=str)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.period for r in per.nearest(frame([], "period"), frame(asked[:3], "target"), 7).collect()} == {None}


def test_dependencies_in_one_shuffle(spark):
    from ebbline.operators.quality import dependencies

    rows = [(f"z{k % 60}", f"c{k % 12}", f"r{k % 3}", k % 60, None if k % 7 == 0 else f"m{k % 4}", 1.5) for k in range(600)]
    df = spark.createDataFrame(rows, "zip string, city string, region string, n int, other string, same double")
    names = tuple(df.columns)
    got = {(r.child, r.parent, r.children, r.parents) for r in dependencies(df.repartition(6), names).collect()}
    want = set()
    for a in range(6):
        for b in range(6):
            parents = {}
            for r in rows:
                if r[a] is not None:
                    parents.setdefault(r[a], set()).add(r[b])
            sizes = [len({r[k] for r in rows if r[k] is not None}) for k in (a, b)]
            if a != b and all(len(p - {None}) <= 1 for p in parents.values()) and sizes[0] > sizes[1]:
                want.add((names[a], names[b], *sizes))
    assert got == want and ("zip", "city", 60, 12) in got
    assert dependencies(df, ()).count() == 0 and dependencies(df.filter("false"), names).count() == 0


def test_month_ranges_reach_the_scan(spark, sf):
    from ebbline.operators.filters import month_span
    from ebbline.plans.registry import QUERIES

    assert tuple(map(str, month_span((1996, 11), (1998, 2)))) == ("1996-11-01", "1998-02-28") and str(month_span((2000, 1), (2000, 12))[1]) == "2000-12-31"
    assert "GreaterThanOrEqual(o_orderdate" in QUERIES["f08_month_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_quantiles_are_exact(spark):
    """Ties, nulls, a null group, groups of one and of nulls alone, and a hot group over several ranges: as the exact percentile."""
    rows = [("hot" if k % 3 else ["b", None, "c"][k % 9 // 3], None if k % 17 == 0 else float(k * 7919 % 1013 // 3)) for k in range(5000)] + [("one", 4.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(11)
    shares = {"low": 0.05, "mid": 0.5, "high": 0.95, "top": 1.0}
    want = df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in shares.items()]).filter("mid IS NOT NULL")
    got = {r.g: r for r in quantiles(df, ("g",), "v", **shares).collect()}
    assert len(got) == 5 and "none" not in got
    for r in want.collect():
        assert all(got[r.g][n] == pytest.approx(r[n], rel=1e-12) for n in shares)
    assert quantiles(df, (), "v", mid=0.5).first().mid == df.agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert quantiles(df.filter("false"), (), "v", mid=0.5).first().mid is None and quantiles(df.filter("false"), ("g",), "v", mid=0.5).count() == 0


def test_robust_z_holds_no_table_in_one_task(spark):
    t = spark.createDataFrame([(k, 100.0 if k == 7 else float(k % 5)) for k in range(40)], "period int, value double")
    out = st.robust_z(t)
    assert "windowspecdefinition(0" not in _plan(out)
    assert [(r.period, r.severity) for r in out.collect()] == [(7, "high")]
