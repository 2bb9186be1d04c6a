"""Small frames with known answers, and identities."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ebbline.functions import dates, text
from ebbline.functions.pvalues import f_upper, incomplete_beta, normal_two_sided, t_two_sided
from ebbline.operators import filters, grouped, kpi, periods, quality, ranking, rollup, series, stats, variance
from ebbline.plans import contract
from ebbline.plans.contract import Contract, Dimension, Kpi, Metric
from ebbline.sources import loaders, sinks

D = dt.date
NOW, THEN = D(2025, 1, 31), D(2024, 1, 31)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_price_volume(spark):
    df = frame(spark, [("A", THEN, 100.0, 50.0), ("B", THEN, 200.0, 40.0), ("A", NOW, 150.0, 60.0), ("B", NOW, 180.0, 45.0)], "item string, period date, revenue double, miles double")
    t = variance.price_volume(df, "item", "revenue", "miles", NOW, THEN).agg(F.sum("total_variance"), F.sum("volume_impact"), F.sum("price_impact"), F.sum("residual")).first()
    assert tuple(t) == pytest.approx((30, 45, -15, 0))


def test_mix_adds_up(spark):
    df = frame(spark, [("x", THEN, 100.0, 10.0), ("y", THEN, 300.0, 10.0), ("x", NOW, 90.0, 6.0), ("y", NOW, 700.0, 20.0)], "seg string, period date, t double, v double")
    r = variance.mix_shift(df, "seg", "t", "v", NOW, THEN).first()
    assert r.volume_effect + r.price_effect + r.mix_effect == pytest.approx(r.total_variance) == pytest.approx(390)


def test_bridge(spark):
    a, b = D(2025, 1, 31), D(2025, 2, 28)
    rows = [("A", a, 100.0), ("B", a, 200.0), ("C", a, 50.0), ("A", b, 120.0), ("B", b, 180.0), ("D", b, 75.0), ("E", b, 25.0)]
    r = variance.bridge(frame(spark, rows, "e string, period date, v double"), "e", "v", b, a).first()
    assert (r.new_count, r.new_total, r.lost_count, r.lost_total, r.same_store_count, r.same_store_delta, r.total_delta) == (2, 100, 1, 50, 2, 0, 50)


def test_concentration(spark):
    duo = stats.concentration(frame(spark, [("a", 50.0), ("b", 50.0)], "item string, value double")).first()
    assert duo.hhi == pytest.approx(5000) and duo.gini == pytest.approx(0) and duo.hhi_label == "concentrated"


def test_tiers(spark):
    df = frame(spark, [("p", "A", 50.0), ("p", "B", 30.0), ("p", "C", 20.0)], "r string, e string, v double")
    assert {r.e for r in ranking.tier_keys(df, ranking.parse_tiers("e:top_pct:80")[0], "v").collect()} == {"A", "B"}
    df = frame(spark, [("R1", "a", 10.0), ("R1", "b", 5.0), ("R1", "c", 1.0), ("R2", "d", 8.0), ("R2", "e", 7.0), ("R2", "f", 1.0)], "r string, e string, v double")
    assert {r.e for r in ranking.tier_filtered(df, ranking.parse_tiers("e:top_n:2@r")[0], "v").collect()} == set("abde")
    zero = frame(spark, [("p", "A", 0.0), ("p", "B", 0.0)], "r string, e string, v double")
    assert ranking.tier_keys(zero, ranking.Tier("e", "top_pct", 80), "v").count() == 2
    with pytest.raises(ValueError):
        ranking.parse_tiers("e:best:3")


def test_policies(spark):
    df = frame(spark, [("3100", 100), ("4100", 200), ("3200", 300)], "k string, v int")
    assert [r.v for r in filters.sign_corrected(df, "k", "v", ("3",)).orderBy("k").collect()] == [-100, -300, 200]
    policy = [("revenue", ("3",), ()), ("expense", ("5", "6"), ())]
    df = frame(spark, [("3100",), ("5010",), ("6010",), ("9999",)], "k string")
    assert [r.c for r in df.orderBy("k").select(filters.classified(F.col("k"), policy).alias("c")).collect()] == ["revenue", "expense", "expense", "specific_item"]


def test_grains(spark):
    def grain(days):
        return periods.grain(frame(spark, [(d,) for d in days], "d date"), "d").first().grain

    assert grain([D(2024, 1, 6) + dt.timedelta(7 * k) for k in range(12)]) == "weekly"
    assert grain([periods.months_back(D(2025, 12, 31), k) for k in range(12)]) == "monthly"
    assert grain([D(2024, 1, 1) + dt.timedelta(k) for k in range(5)]) == "unknown"


def test_periods():
    months = [periods.months_back(D(2025, 1, 31), k) for k in range(24)][::-1]
    assert months[-13] == D(2024, 1, 31) and periods.months_back(D(2024, 3, 31), 1) == D(2024, 2, 29)
    assert periods.current(months, 1) == D(2024, 12, 31) and periods.current(months, 99) == months[-1] and periods.current(months, 0, "2024-05") == D(2024, 5, 31)
    assert periods.prior(months, NOW, "yoy") == THEN and periods.prior(months, NOW, "mom") == D(2024, 12, 31) and periods.prior(months[-3:], NOW, "yoy") is None
    assert periods.pvm_prior(months, NOW) == THEN and periods.pvm_prior(months[-2:], NOW) == D(2024, 12, 31)
    assert len(dates.GRAINS) == 22 and dates.grain_of(" Annually ") == "yearly" and dates.grain_of("yr") == "yearly" and dates.grain_of("qr") == "quarterly" and dates.grain_of("mon") == "monthly" and dates.grain_of("?") == dates.grain_of(None) == "unknown" and dates.comparison_of("odd") == "PoP"


def test_buckets(spark):
    r = frame(spark, [(D(2024, 2, 14),)], "d date").select(*[f(F.col("d")).alias(k) for k, f in dates.BUCKETS.items()], dates.month_end_of(F.lit(2024), F.lit(15)).alias("capped")).first()
    assert (r.weekly, r.weekly_saturday, r.monthly, r.quarterly, r.yearly, r.capped) == (D(2024, 2, 18), D(2024, 2, 17), D(2024, 2, 29), D(2024, 3, 31), D(2024, 12, 31), D(2024, 12, 31))
    sunday = frame(spark, [(D(2024, 2, 18),)], "d date").select(dates.week_end_sunday(F.col("d")).alias("s")).first()
    assert sunday.s == D(2024, 2, 18)


def test_levels_sum_to_parents(spark):
    df = frame(spark, [("r", "x", 1.0), ("r", None, 2.0), (None, "y", 4.0)], "region string, nation string, v double")
    out = {(r.level, r.item): r.v for r in rollup.all_levels(df, ("region", "nation"), F.sum("v").alias("v")).collect()}
    assert out[(0, "Total")] == 7 and out[(1, "r")] == 3 and out[(1, "(Unassigned)")] == 4 and sum(v for (k, _), v in out.items() if k == 2) == 7


def test_level_statistics(spark):
    df = frame(spark, [("a", NOW, 120.0), ("a", THEN, 100.0), ("b", NOW, 30.0), ("c", THEN, 50.0)], "item string, period date, v double")
    rows = {(r.level, r["item"]): r for r in variance.level_statistics(df.withColumnRenamed("item", "k"), ("k",), "v", NOW, THEN, absolute=25.0).collect()}
    assert rows[(0, "Total")].variance_dollar == 0 and rows[(1, "b")].is_new_from_zero and rows[(1, "b")].variance_pct is None
    assert rows[(1, "c")]["rank"] == 1 and rows[(1, "c")].variance_pct == -100 and rows[(1, "a")].materiality == "HIGH"
    assert sum(r.share_current for (k, _), r in rows.items() if k == 1) == pytest.approx(1) and max(r.cumulative_pct for (k, _), r in rows.items() if k == 1) == pytest.approx(100)
    gone = variance.level_statistics(df.withColumnRenamed("item", "k"), ("k",), "v", NOW, D(1990, 1, 31))
    assert {r.variance_dollar for r in gone.collect()} == {0.0}


def test_ratios_divide_last(spark):
    df = frame(spark, [(NOW, 1.0, 10.0), (NOW, 9.0, 10.0), (THEN, 5.0, 0.0)], "period date, n double, d double")
    k = Kpi("r", "n", denominator="d", multiply=100)
    out = {r.period: r.r for r in kpi.derived_series(df, (), (k,), {"r": k}).collect()}
    assert out == {NOW: 50.0, THEN: None}
    days = Kpi("p", "n", divide_by="period_days")
    assert contract.kpi_parts(days, {}, 30) == ("n", "(30)") and contract.kpi_formula(Kpi("q", "p"), {"p": days}, 30) == "((n) / nullif((30), 0))"
    with pytest.raises(ValueError):
        contract.kpi_formula(Kpi("a", "b"), {"a": Kpi("a", "b"), "b": Kpi("b", "a")})
    with pytest.raises(ValueError):
        contract.checked("n; drop", ["n"])
    with pytest.raises(ValueError):
        contract.checked("exec(n)", ["n"])


def test_contract():
    c = Contract("c", "t", "monthly", (Metric("a", lag_periods=2), Metric("b", depends_on=("a", "b"))), (Dimension("Area", "area", tags=("zone",)),), {"h": ("area", "town")})
    assert c.effective_lag("b") == 2 and c.filters({"zone": ["x", "All zones"], "other": 1}) == {"area": ["x"]} and c.levels("h", {"area": ["x"]}) == ["town"]
    with pytest.raises(ValueError):
        Metric("m", type="odd")
    with pytest.raises(ValueError):
        Dimension("d", role="odd")
    assert contract.columns_in("a + coalesce(b, 0) / nullif('c', d)") == {"a", "b", "d"}


def test_series_rules(spark):
    rows = [("up", D(2024, m, 1), float(m * m)) for m in range(1, 10)] + [("flat", D(2024, m, 1), float(m % 2)) for m in range(1, 10)]
    df = frame(spark, rows, "item string, period date, value double")
    assert {r["item"]: r.is_cumulative for r in series.cumulative_items(df).collect()} == {"up": True, "flat": False}
    assert [r.value for r in series.decumulated(df.filter("item = 'up'")).orderBy("period").collect()] == [1.0, *[float(2 * m - 1) for m in range(2, 10)]]
    smooth = series.smoothed(df.filter("item = 'up'"), window=3).orderBy("period").collect()
    assert smooth[0].smoothed == smooth[2].smoothed == pytest.approx(14 / 3)


def test_loader(spark):
    raw = frame(spark, [("N", "$1,200", "-"), ("S", "5%", "x")], "Region string, `1/7/2024` string, `1/14/2024` string")
    path = sinks.shared_path(spark, "report")
    raw.write.option("header", True).option("sep", "\t").option("encoding", "UTF-16").csv(path)
    out = {(r.Region, r.period): r.value for r in loaders.weekly_report(spark, path, ("Region",), known_partial=()).collect()}
    assert out == {("N", D(2024, 1, 7)): 1200.0, ("N", D(2024, 1, 14)): None, ("S", D(2024, 1, 7)): 5.0, ("S", D(2024, 1, 14)): None}


def test_quality(spark):
    df = frame(spark, [("x", 1), ("x", 1), ("y", 2)], "a string, b int")
    assert quality.missing_columns(df, ("a", "z")) == ["z"] and quality.duplicate_rows(df, ("a", "b")).first().duplicates == 1


def test_tails():
    assert normal_two_sided([1.959963984540054])[0] == pytest.approx(0.05)
    assert t_two_sided([2.2281388519649385], [10])[0] == pytest.approx(0.05, rel=1e-6)
    assert f_upper([4.964602743730711], [1], [10])[0] == pytest.approx(0.05, rel=1e-6)
    assert incomplete_beta(2.0, 3.0, 0.5) == pytest.approx(0.6875)


def test_seasonal_and_changes(spark):
    season = [5, 3, 1, -1, -3, -5, -5, -3, -1, 1, 3, 5]
    days = [periods.months_back(D(2024, 12, 31), 47 - k) for k in range(48)]
    rows = [("s", d, k + 1, 100.0 + 2 * k + season[k % 12]) for k, d in enumerate(days)] + [("j", d, k + 1, 10.0 if k < 30 else 90.0 + (k % 3)) for k, d in enumerate(days)]
    df = frame(spark, rows, "item string, period date, period_idx int, value double")
    parts = stats.seasonal(df.filter("item = 's'")).orderBy("period").collect()
    assert all(p.residual == pytest.approx(0, abs=1e-6) for p in parts) and [round(p.seasonal, 6) for p in parts[:12]] == season
    changes = grouped.change_points(df.filter("item = 'j'")).collect()
    assert changes[0].change_point_index == 30 and changes[0].before_mean == pytest.approx(10)
    misses = grouped.holdout_forecasts(df.filter("item = 's'")).collect()
    assert len(misses) == 10 and not any(m.miss for m in misses)


def test_multi_way_against_least_squares_of_rows(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, 600)
    b = np.where(rng.random(600) < 0.7, a, rng.integers(0, 4, 600))  # goes along with a
    c = rng.integers(0, 2, 600)
    keep = ~((a == 2) & (c == 1))  # a combination that never occurs
    a, b, c = a[keep], b[keep], c[keep]
    y = 1000 + 5.0 * a + 4.0 * ((b == 1) & (c == 1)) + rng.normal(0, 1, len(a))
    dummies = {k: np.eye(v.max() + 1)[v][:, 1:] for k, v in zip("abc", (a, b, c))}
    for p, q in itertools.combinations("abc", 2):
        dummies[f"{p}:{q}"] = np.column_stack([u * v for u in dummies[p].T for v in dummies[q].T])

    def fit(terms):
        x = np.column_stack([np.ones(len(y)), *[dummies[t] for t in terms]])
        coef, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        return ((y - x @ coef) ** 2).sum(), rank

    left, rank = fit(dummies)
    got = {r.term: r for r in grouped.multi_way(frame(spark, [(*map(int, r[:3]), float(r[3])) for r in zip(a, b, c, y)], "a int, b int, c int, y double"), ("a", "b", "c"), "y").collect()}
    assert set(got) == {*dummies, "residual"} and got["residual"].sum_sq == pytest.approx(left) and got["residual"].df == len(y) - rank
    for t in dummies:
        others = [u for u in dummies if not set(t.split(":")) <= set(u.split(":"))]
        (r0, d0), (r1, d1) = fit(others), fit([*others, t])
        assert got[t].sum_sq == pytest.approx(r0 - r1, abs=1e-6) and got[t].df == d1 - d0
    assert sum(r.eta_squared for r in got.values()) == pytest.approx(1) and got["b:c"].p_value < 1e-6 and got["b"].eta_squared < 0.25 * got["a"].eta_squared


def test_multi_way_of_many_levels(spark):
    """Factors of 10,000 and 300 levels: a balanced table has its answer in closed form, and one with holes agrees with two_way."""
    rows = spark.range(0, 60_000).select((F.col("id") % 10_000).alias("a"), (F.floor(F.col("id") / 10_000) % 3).alias("b"), (F.floor(F.col("id") / 30_000)).alias("c")).withColumn("y", (F.hash("a") % 100 + 7 * F.col("b") + F.hash("b", "c") % 5 + F.hash("a", "b", "c") % 3).cast("double"))
    got = {r.term: r for r in grouped.multi_way(rows, ("a", "b", "c"), "y").collect()}
    assert [got[t].df for t in ("a", "b", "c", "a:b", "a:c", "b:c", "residual")] == [9999.0, 2.0, 1.0, 19998.0, 9999.0, 2.0, 19998.0]
    mean = rows.agg(F.avg("y")).first()[0]
    for t in "abc":
        alone = rows.groupBy(t).agg(F.count("*").alias("n"), F.avg("y").alias("m")).agg(F.sum(F.col("n") * (F.col("m") - mean) ** 2)).first()[0]
        assert got[t].sum_sq == pytest.approx(alone)
    holes = rows.withColumn("b", F.pmod(F.hash("a", "b", "c"), F.lit(300))).select("a", "b", "y")
    one = {r.term: (r.sum_sq, r.df) for r in grouped.multi_way(holes, ("a", "b"), "y").collect()}
    two = {r.term: (r.sum_sq, r.df) for r in grouped.two_way(holes, "a", "b", "y").collect()}
    assert one.keys() == two.keys() and all(one[t] == pytest.approx(two[t]) for t in one)


def test_ranks_of_designs():
    import numpy as np

    rng = np.random.default_rng(3)
    for sizes, m in (((4, 5, 3), 30), ((6, 7, 5), 60), ((3, 3, 3), 12)):
        cells = np.unique(np.stack([rng.integers(0, k, m) for k in sizes], 1), axis=0).T
        pair = lambda i, j: np.unique(cells[i] * 100 + cells[j], return_inverse=True)[1]
        single = [np.unique(v, return_inverse=True)[1] for v in cells]
        for groups in (single[:2], single, [pair(0, 1), single[2]], [pair(0, 1), pair(0, 2), pair(1, 2)]):
            assert grouped._rank(groups) == np.linalg.matrix_rank(np.hstack([np.eye(g.max() + 1)[g] for g in groups]))


def test_pairs_of_all_items(spark):
    """Brands that no list names decide, and the largest lead whatever they are called."""
    wave = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0]
    noise = {"Brand#11": [3.0, 1.0, 2.0, 1.0, 3.0, 2.0], "Brand#12": [1.0, 1.0, 4.0, 1.0, 2.0, 1.0]}
    alike = {f"Brand#{40 + k}": [100.0 * k + k * v for v in wave] for k in range(1, 8)}
    rows = [(item, D(2025, k + 1, 1), k + 1, v) for item, vs in {**noise, **alike, "Brand#50": [7.0] * 6}.items() for k, v in enumerate(vs)]
    s = frame(spark, rows, "item string, period date, period_idx int, value double")
    assert stats.item_correlations(s).count() == 45  # ten items
    r = stats.uniform_growth(s).first()
    assert (r.pairs, r.strong, r.uniform) == (36, 21, True)  # Brand#50 doesn't vary
    assert {x.item for x in stats.leading_items(s, 4).collect()} == {"Brand#44", "Brand#45", "Brand#46", "Brand#47"}


def test_two_way_is_balanced(spark):
    rows = [(a, b, float(3 * a + b + (a * b) + e)) for a in range(3) for b in range(2) for e in (-0.5, 0.5)]
    out = {r.term: r for r in grouped.two_way(frame(spark, rows, "a int, b int, y double"), "a", "b", "y").collect()}
    total = sum(r.sum_sq for r in out.values())
    mean = sum(y for *_, y in rows) / len(rows)
    assert total == pytest.approx(sum((y - mean) ** 2 for *_, y in rows)) and out["residual"].sum_sq == pytest.approx(3.0)


def test_formats(spark):
    r = frame(spark, [(1234567.0,)], "x double").select(text.abbreviated(F.col("x")).alias("a"), text.currency(-F.col("x")).alias("c"), text.signed(F.col("x")).alias("s"), text.slug(F.lit(" Net Sales (US) ")).alias("g")).first()
    assert tuple(r) == ("1.2M", "-$1,234,567", "+1.2M", "net_sales_us")


def test_inference(spark):
    from ebbline.operators.inference import chains, propose

    rows = [(str(k), f"2024-{k % 12 + 1:02d}-01", f"${k * 37 % 1000}.5", str(round(k % 7 / 10, 1)), ("N", "S")[k % 2], f"city{k % 10}") for k in range(300)]
    found, roles = propose(frame(spark, rows, "id string, day string, sales string, rate string, region string, city string"), "x")
    assert roles == {"id": "identifier", "day": "time", "sales": "metric", "rate": "ratio", "region": "dimension", "city": "dimension"}
    assert found.hierarchies == {"by_region": ("region", "city")} and found.frequency == "monthly" and found.time == "day"
    sizes = {"brand": 3, "region": 4, "ptype": 9, "nation": 12, "town": 30}
    links = {("nation", "region"), ("town", "region"), ("town", "nation"), ("ptype", "brand")}
    assert chains(list(sizes), sizes, links) == {"by_brand": ("brand", "ptype"), "by_region": ("region", "nation", "town")}  # independent chains stay apart
    assert chains(list(sizes), sizes, links, levels=2)["by_region"] == ("region", "nation")
    assert chains(["city", "x", "state"], {"city": 2, "x": 3, "state": 5}, set()) == {"by_state": ("state", "city")} and chains(["b", "a"], {"a": 5, "b": 2}, set()) == {"by_b": ("b", "a")} and chains(["a"], {"a": 5}, set()) == {}
    many = frame(spark, [(f"p{k}", f"c{k % 7}") for k in range(1200)], "product string, kind string")
    assert propose(many, "y")[1] == {"product": "dimension", "kind": "dimension"} and propose(many, "y")[0].hierarchies != propose(many, "y", most_values=2000)[0].hierarchies == {"by_kind": ("kind", "product")}


def test_support_rules(spark):
    c = Contract("c", "t", "monthly", (Metric("m", type="ratio", formula="100 * a / b"),), kpis=(Kpi("k", "a", denominator="d"),))
    assert contract.ratio_config("m", {}, c) == ("a", "b") and contract.ratio_config("k", {}, c) == ("a", "(d)") and contract.ratio_config("m", {"m": {"numerator": "x", "denominator": "y"}}, c) == ("x", "y") and contract.ratio_config("z", {}, c) is None
    assert contract.chosen_grain(declared="daily", median_gap=7) == "weekly" and contract.chosen_grain(detected="unknown") == "monthly" and contract.chosen_grain(aggregated="yearly", declared="daily") == "yearly"
    path = sinks.shared_path(spark, "source")
    sinks.export_csv(frame(spark, [("a", 1)], "k string, v int"), path)
    assert loaders.open_source(spark, {"type": "csv", "path": path}).first().v == "1"


def test_normality_of_short_flat_and_skewed_items(spark):
    values = {"short": [1.0, 5.0], "three": [1.0, 2.0, 9.0], "flat": [3.0] * 12, "even": [float(k) for k in (1, 2, 3, 3, 4, 4, 4, 5, 5, 6, 7)], "skewed": [1.0] * 10 + [1.1, 1.2, 50.0], "nulls": [None] * 9}
    items = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "item string, value double")
    got = {r["item"]: r for r in stats.normality(items).collect()}
    assert {k for k, r in got.items() if r.classification == "insufficient" and r.statistic is None and not r.is_normal} == {"short", "three", "flat", "nulls"}
    assert got["even"].classification == "normal" and got["skewed"].classification == "right_skewed" and got["skewed"].normality_p_value < 0.001
    assert got["nulls"].n_observations == 0 and stats.normality(items.filter("false")).count() == 0


def test_small_sample_tests():
    from ebbline.functions.pvalues import chi2_upper, shapiro_wilk

    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])  # the published example
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.0003)
    assert shapiro_wilk([1, 1, 1])[1] != shapiro_wilk([1, 1, 1])[1] and shapiro_wilk([1.0, 2.0, 3.0])[0] == pytest.approx(1)
    assert chi2_upper([3.841458820694124, 18.307038053275146], [1, 10]).tolist() == pytest.approx([0.05, 0.05])


def test_cheapest_cut_of_all(spark):
    """Change points against every possible cut of a short series."""
    import itertools

    import numpy as np

    v = [3.0, 4, 3, 4, 9, 8, 9, 10, 9, 2, 1, 2, 1, 2]
    n, best = len(v), None
    penalty = 3 * np.var(v) * np.log(n)
    for k in range(4):
        for cut in itertools.combinations(range(3, n - 2), k):
            ends = [0, *cut, n]
            if min(np.diff(ends)) >= 3:
                cost = sum(((np.array(v[a:b]) - np.mean(v[a:b])) ** 2).sum() for a, b in itertools.pairwise(ends)) + penalty * k
                best = min(best or (np.inf,), (cost, cut))
    rows = [("x", D(2024, 1, 1) + dt.timedelta(k), float(x)) for k, x in enumerate(v)]
    got = grouped.change_points(frame(spark, rows, "item string, period date, value double")).orderBy("period").collect()
    assert tuple(r.change_point_index for r in got) == best[1]


def test_granger_against_normal_equations(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=60), np.zeros(60)
    for k in range(2, 60):
        y[k] = 0.5 * y[k - 1] + 0.8 * x[k - 1] + 0.1 * rng.normal()
    rows = [("x", "y", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))]
    got = grouped.granger(frame(spark, rows, "leader string, follower string, period_idx int, x double, y double")).first()

    def left(columns):
        m = np.column_stack(columns)
        b = np.linalg.solve(m.T @ m, m.T @ y[2:])
        return ((y[2:] - m @ b) ** 2).sum()

    own = [np.ones(58), y[1:-1], y[:-2]]
    r0, r1 = left(own), left([*own, x[1:-1], x[:-2]])
    two = (r0 - r1) / 2 / (r1 / 53)
    m1, m0 = (np.column_stack(c) for c in ([np.ones(59), y[:-1], x[:-1]], [np.ones(59), y[:-1]]))
    s1, s0 = (((y[1:] - m @ np.linalg.solve(m.T @ m, m.T @ y[1:])) ** 2).sum() for m in (m1, m0))
    assert got.f == pytest.approx({1: (s0 - s1) / (s1 / 56), 2: two}[got.lags]) and got.p_value < 1e-6
    only = grouped.granger(frame(spark, rows[:4], "leader string, follower string, period_idx int, x double, y double")).first()
    assert only.lags is None and only.p_value is None or only.p_value != only.p_value


def test_two_way_of_unbalanced_cells(spark):
    """Against dummy regressions, with an empty cell and no limit on levels."""
    import numpy as np

    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 12, 500), rng.integers(0, 5, 500)
    keep = ~((a == 1) & (b == 2))
    a, b = a[keep], b[keep]
    y = 100 + a + 3.0 * b + rng.normal(0, 1, len(a))
    one = np.ones((len(y), 1))
    da, db = np.eye(12)[a][:, 1:], np.eye(5)[b][:, 1:]
    sse = lambda *m: float(((y - np.hstack(m) @ np.linalg.lstsq(np.hstack(m), y, rcond=None)[0]) ** 2).sum())
    got = {r.term: r for r in grouped.two_way(frame(spark, [(int(i), int(j), float(v)) for i, j, v in zip(a, b, y)], "a int, b int, y double"), "a", "b", "y").collect()}
    assert got["a"].sum_sq == pytest.approx(sse(one, db) - sse(one, da, db)) and got["b"].sum_sq == pytest.approx(sse(one, da) - sse(one, da, db)) and (got["a"].df, got["b"].df) == (11, 4)


def test_defaults_on_planted_series(spark):
    months = [periods.months_back(D(2024, 12, 31), 23 - k) for k in range(24)]
    up = [("up", d, k + 1, 100.0 + 10 * k) for k, d in enumerate(months)]
    down = [("down", d, k + 1, 400.0 - 12 * k) for k, d in enumerate(months)]
    flat = [("flat", d, k + 1, 50.0 + (k % 2)) for k, d in enumerate(months)]
    spike = [("spike", d, k + 1, 900.0 if k == 23 else 10.0 + k % 3) for k, d in enumerate(months)]
    s = frame(spark, up + down + flat + spike, "item string, period date, period_idx int, value double")
    told = {r["item"]: r.diverging for r in variance.trend_divergence(s.filter("item <> 'spike'")).collect()}
    assert told == {"up": True, "down": True, "flat": False}  # the whole falls by 2 a month, five times slower than either
    out = stats.leave_k_out(s).collect()
    assert [r["item"] for r in out] == ["spike"] and out[0].marginal_impact == pytest.approx(900 - (sum(10 + k % 3 for k in range(23)) / 23))
    moves = {r["item"]: r.persistent for r in ranking.persistent_movers(s, top=2).collect()}
    assert moves["down"] and moves["up"] and not moves.get("flat", False)
    assert {r.k: r.is_major for r in ranking.major_shares(frame(spark, [("a", 95.0), ("b", 5.0), ("c", 0.1)], "k string, v double"), "k", "v").collect()} == {"a": True, "b": False, "c": False}
    shape = {r["item"]: r for r in stats.distribution(s).collect()}
    assert shape["spike"].z_score_reliability == "low" and "heavy_tailed" in shape["spike"].classification and shape["up"].normality_p_value > 0.05
    run = frame(spark, [("t", d, float(sum(range(k + 2)))) for k, d in enumerate(months)] + [("p", d, 10.0 if k % 2 else 20.0) for k, d in enumerate(months)], "item string, period date, value double")
    pop = {(r["item"], r.period): r for r in variance.period_over_period(run, last=3).collect()}
    assert len(pop) == 6 and pop[("t", months[-1])].value == 24 and pop[("t", months[-1])].change == 1 and pop[("p", months[-1])].change_pct == -50
    assert variance.bridge_periods(months, "YoY") == (months[-1], months[-13], "YoY") and variance.bridge_periods(months[:5], "YoY")[2] == "MoM" and variance.bridge_periods(months[:1]) is None
    like = ranking.similar_history(frame(spark, [("a", months[k], v) for k, v in enumerate([9.0, 9.0, 1.0, 8.0, 10.0])], "item string, period date, d double"), "item", "d", months[4])
    assert [r.d for r in like.orderBy("period").collect()] == [9.0, 8.0]  # of the last three
    assert filters.focus_settings(("anomaly_detection", "recent_monthly_trends"), "daily") == {"z_threshold": 1.5, "focus_periods": 6} and filters.focus_settings((), "daily")["focus_periods"] == 14


def test_alerts_share_signals(spark):
    from ebbline.operators import alerts as al

    day = D(2024, 1, 31)
    z = frame(spark, [("a", day, 30.0, 10.0, 3.5), ("b", day, 12.0, 10.0, 2.1)], "item string, period date, value double, avg double, z_score double")
    cps = frame(spark, [("b", day, 5.0, 50.0)], "item string, period date, magnitude_dollar double, magnitude_pct double")
    quiet = frame(spark, [("a", 0.7), ("c", 0.4)], "item string, cv double")
    out = {r.id: r for r in al.extracted([al.anomaly_alerts(z), al.change_alerts(cps), al.volatility_alerts(quiet)]).withColumn("confidence", al.confidence(F.col("signals"))).collect()}
    assert set(out) == {"anomaly:a:2024-01-31", "anomaly:b:2024-01-31", "structural_break:b:2024-01-31", "volatility:a:all"}
    assert [out[k].confidence for k in sorted(out)] == pytest.approx([0.8, 0.95, 0.95, 0.0])  # b has four signals from both
    assert al.extracted([al.anomaly_alerts(z)], {"anomaly": 1}).first().item == "a"
    r = frame(spark, [(40.0, 0.1, 50.0, 100.0), (40.0, 0.1, 1.0, None)], "pct double, share double, amount double, revenue double").select(al.impact(F.col("pct"), F.col("share"), F.col("amount"), F.col("revenue")).alias("i")).collect()
    assert r[0].i == 1.0 and r[1].i == pytest.approx(0.8 * (0.3 + 0.7 * 0.4))
    rules = frame(spark, [(["a*", "x"], None, ["2024-01-31"], 0.9), (["b"], ["volatility"], [], 1.0)], al.RULES)
    scored = frame(spark, [("1", "a1", "anomaly", day, 0.5), ("2", "a1", "anomaly", D(2024, 2, 29), 0.5), ("3", "b", "anomaly", day, 0.5), ("4", "b", "volatility", day, 0.5), ("5", "a1", "anomaly", day, 0.95)], "id string, item string, category string, period date, score double")
    none = frame(spark, [], "item string, period string"), frame(spark, [], "id string, tag string")
    assert {r.id for r in al.suppressed(scored, rules, *none).filter("suppressed_by = 'rule'").collect()} == {"1", "4"}


def test_cards_of_planted_findings(spark):
    from ebbline.operators import cards

    day = D(2024, 1, 31)
    one = lambda df: {r.title: (r.priority, r.score) for r in df.collect()}
    z = frame(spark, [("a", day, 30.0, 10.0, 4.2, 0.5), ("b", day, 10.5, 10.0, 1.0, 0.5)], "item string, period date, value double, avg double, z_score double, share double")
    assert one(cards.anomalies(z, [day])) == {"Anomaly: a in 2024-01-31": ("critical", pytest.approx(0.72))} and cards.anomalies(z, [day]).first().recent
    pairs = frame(spark, [("a", "b", -0.9, 0.01), ("a", "c", 0.9, 0.2)], "a string, b string, r double, p_value double")
    assert one(cards.correlations(pairs)) == {"Correlation: a vs b": ("high", 0.45)}
    bridge = frame(spark, [(100.0, 90.0, 10.0, 40.0, 20.0, -10.0, 3, 2, 5, 400.0, -200.0, -100.0)], "total_current double, total_prior double, total_delta double, new_total double, lost_total double, same_store_delta double, new_count long, lost_count long, same_store_count long, new_pct_of_delta double, lost_pct_of_delta double, same_store_pct_of_delta double")
    assert one(cards.bridges(bridge)) == {"Portfolio Churn: 3 new, 2 lost entities": ("critical", 0.6), "New Entities: 3": ("high", 0.5), "Lost Entities: 2": ("high", 0.5), "Same-Store Organic Change: 5 entities": ("low", 0.04)}
    anova = frame(spark, [("r", 0.3), ("s", 0.1), ("r:s", 0.2), ("residual", 0.4)], "term string, eta_squared double")
    assert one(cards.variance_drivers(anova)) == {"Primary Variance Driver: r": ("medium", 0.24), "Interaction Effect: r x s": ("medium", 0.3), "High Unexplained Variance": ("medium", 0.4)}
    leads = frame(spark, [("x", "y", 2, -0.8, 0.3)], "leader string, follower string, optimal_lag int, lag_r double, improvement double")
    assert one(cards.leading_indicators(leads)) == {"Leading Indicator: x predicts y": ("critical", 0.64)}
    whole = frame(spark, [(110.0, 100.0, 2.0, 1.0)], "latest_with double, latest_without double, slope_with double, slope_without double")
    assert one(cards.outlier_impacts(whole)) == {"Outlier-Adjusted Run Rate": ("high", pytest.approx(0.4545)), "Outlier-Adjusted Trend": ("high", 0.5)}


def test_rollups_keep_rules_when_rolled_again(spark):
    df = frame(spark, [("r", f"n{k}", f"c{k}", float(k), k / 10) for k in range(8)], "r string, n string, c string, v double, rate double")
    out, keys = rollup.within_rows(df, ("r", "n", "c"), (Metric("v"), Metric("rate", type="ratio")), 3)
    row = out.first()
    assert keys == ("r",) and row.v == 28 and row.rate == pytest.approx(0.35)
    days = frame(spark, [(D(2024, 1, 1) + dt.timedelta(k), 1.0) for k in range(14)], "d date, v double")
    assert rollup.auto_weekly(days, "d", (), (Metric("v"),)).count() == 14 and rollup.auto_weekly(days, "d", (), (Metric("v"),), 13).count() == 2
    placed = __import__("ebbline.operators.ordered", fromlist=["numbered"]).numbered(frame(spark, [(k,) for k in range(50)], "x int"), F.desc("x"), before="x").collect()
    assert {r.x: (r.row, r.before) for r in placed} == {x: (50 - x, sum(range(x + 1, 50))) for x in range(50)}


def test_divergence_and_price(spark):
    df = frame(spark, [("A", THEN, 100.0, 50.0), ("A", NOW, 90.0, 55.0), ("B", THEN, 100.0, 10.0), ("B", NOW, 120.0, 10.4), ("C", NOW, 5.0, 1.0)], "g string, period date, r double, q double")
    c = variance.growth(df, "g", NOW, THEN, rev="r", vol="q")
    told = {r.g: r for r in variance.price_yield(variance.metric_divergence(c, "rev", "vol"), "rev", "vol").collect()}
    assert told["A"].diverges and told["A"].price_pct == pytest.approx(-20) and told["A"].label == "volume up, price down"
    assert not told["B"].diverges and told["B"].rate_mismatch and told["B"].label == "volume and price up"
    assert told["C"].rev is None and not told["C"].diverges


def test_extremes_shares_and_display(spark):
    s = frame(spark, [("A", THEN, 10.0), ("A", NOW, 9.5), ("B", THEN, 10.0), ("B", NOW, 4.0), ("C", THEN, 1.0)], "item string, period date, value double")
    assert {r.item: (r.near_high, r.near_low) for r in variance.near_extremes(s, NOW).collect()} == {"A": (True, True), "B": (False, True)}
    rows = frame(spark, [("g", "a", 4.0), ("g", "b", 3.0), ("g", "c", 2.0), ("g", "d", 1.0), ("h", "a", 0.0)], "g string, i string, v double")
    found = {r.g: (r.top_share, r.at_risk) for r in variance.top_share_risk(rows, "g", "i", "v").collect()}
    assert found["g"] == (pytest.approx(0.9), True) and found["h"] == (None, None)
    st_ = frame(spark, [(1, 1, 6.0), (1, 2, -3.0), (1, 3, 1.0), (2, 1, 5.0)], "level int, rank int, variance_dollar double")
    assert sorted((r.level, r.rank, round(r.shown_cumulative_pct, 4)) for r in variance.displayed_cumulative(st_, 2).collect()) == [(1, 1, 66.6667), (1, 2, 100.0), (2, 1, 100.0)]


def test_events_and_years(spark):
    d = frame(spark, [("m", D(2024, 1, 5), 2.0), ("m", D(2024, 1, 6), 99.0), ("m", D(2024, 1, 8), 3.0), ("z", D(2024, 1, 8), 1.0)], "k string, day date, v double")
    assert {r.k: r.ratio for r in variance.event_ratio(d, "k", "v", ("2024-01-08", "2024-01-09"), ("2024-01-01", "2024-01-07")).collect()} == {"m": 1.5, "z": None}
    y = frame(spark, [("a", D(2023, 5, 1), 10.0), ("a", D(2024, 5, 1), 15.0), ("b", D(2023, 5, 1), 10.0), ("b", D(2024, 5, 1), 40.0), ("b", D(2022, 5, 1), 7.0)], "g string, day date, v double")
    assert {r["item"]: (round(r.yoy_pct, 6), r["rank"]) for r in variance.yearly_truth(y, "g", "day", "v", 2024).collect()} == {"Total": (175, 1), "b": (300, 1), "a": (50, 2)}
    assert {r.g: (r.current, r.prior) for r in rollup.year_pair(y, "g", "day", "v", 2023).collect()} == {"a": (10, None), "b": (10, 7)}


def test_entities(spark):
    rows = frame(spark, [(1, 10, 5.0), (1, 11, 5.0), (2, 12, 30.0), (2, 12, 10.0), (3, 13, 0.0)], "c int, o int, v double")
    assert [(r.c, r.total, r.orders, r.per_order, r.share_pct) for r in ranking.top_entities(rows, "c", "o", "v", 2).collect()] == [(2, 40, 1, 40, 80), (1, 10, 2, 5, 20)]
    cells = frame(spark, [("a", 5.0, 10.0), ("a", 12.0, 10.0), ("b", 3.0, 0.0)], "e string, current double, prior double")
    assert [(r.e, r.moved, r.most_pct) for r in ranking.moved_entities(cells, "e").collect()] == [("a", 7, 50), ("b", 3, None)]
    seen = frame(spark, [("x", NOW), ("y", THEN), ("z", NOW), ("z", THEN), (None, NOW), ("w", D(2020, 1, 31))], "e string, period date")
    assert {(r.kind, r.e) for r in ranking.entity_sets(seen, "e", NOW, THEN).collect()} == {("new", "x"), ("lost", "y"), ("same", "z")}


def test_summaries(spark):
    rows = frame(spark, [("2024-01", "r", 1, 5.0), ("2024-01", "r", 1, 5.0), ("2024-01", "s", 2, 1.0), ("2024-02", "r", 3, 2.0)], "m string, g string, o int, v double")
    found = {(r.m, r.g): (r.v, r.lines, r.orders) for r in rollup.order_summary(rows, "m", "g", "o", "v").collect()}
    assert found[(None, None)] == (13, 4, 3) and found[("2024-01", None)] == (11, 3, 2) and found[("2024-01", "r")] == (10, 2, 1)
    s = frame(spark, [("a", THEN, 10.0), ("a", NOW, 30.0), ("b", THEN, 5.0), ("b", NOW, 5.0)], "i string, period date, v double")
    r = rollup.series_summary(s, "i", "v").first()
    assert (r.periods, r.first_period, r.highest_period, r.lowest_period, r["items"], r.high_cv) == (2, THEN, NOW, THEN, 2, 1)
    assert tuple(rollup.run_metadata(s, "i").first()) == (4, 2, 2) and tuple(rollup.run_metadata(s.limit(0), "i").first()) == (0, 0, 0)
    sc = {r.i: (r.total, round(r.share_pct, 6), round(r.deviation_pct, 6)) for r in rollup.scenario_summaries(s, "i", "v", "period", "b").collect()}
    assert sc == {"a": (40, 80, 300), "b": (10, 20, 0)}
    t = frame(spark, [(D(2023, 1, 31), 1.0), (D(2024, 1, 31), 3.0), (D(2023, 7, 31), 6.0)], "period date, v double")
    assert tuple(rollup.calendar_seasonality(t, "v").first()) == (7, 1, 100)


def test_checks_of_columns(spark):
    df = frame(spark, [("2024-01-05", "$1,000"), ("soon", "-5%"), ("2024-02-01", None), (None, "x")], "d string, v string")
    assert tuple(df.agg(quality.unreadable_dates(F.col("d"), "yyyy-MM-dd"), quality.not_numeric(F.col("v"))).first()) == (2, 2)
    best = quality.best_format(df, "d").first()
    assert best.format == "yyyy-MM-dd" and best.share == pytest.approx(2 / 3) and not best.is_time and quality.best_format(df, "v").count() == 0
    n = quality.number_profile(df, "v").first()
    assert (round(n.share, 6), n.lo, n.hi, n.negatives, n.distinct) == (0.666667, -5, 1000, 1, 2)
    parent = frame(spark, [("a", 10.0), ("b", 5.0), ("c", 1.0)], "k string, v double")
    child = frame(spark, [("a", 4.0), ("a", 6.0), ("b", 4.9), ("d", 1.0)], "k string, v double")
    assert {r.k: r.adds_up for r in quality.rollup_integrity(parent, child, "k", "v").collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert quality.row_budget(parent, 3).first().within_budget and not quality.row_budget(parent, 2).first().within_budget
    o = frame(spark, [("2024-01-01", 100.0), ("2024-03-01", 300.0)], "d string, v double")
    assert tuple(quality.suggestions(o, "v", "d").first()) == (10, 2)


def test_alert_scopes(spark):
    from ebbline.operators import alerts

    geo = frame(spark, [("ASIA", "Japan"), ("ASIA", None), ("EUROPE", "France")], "p string, c string")
    f = frame(spark, [("Japan rose",), ("ASIA fell",), ("France",), (None,)], "item string")
    assert {r["item"] for r in alerts.in_scope(f, geo, "p", "c", "ASIA").collect()} == {"Japan rose", "ASIA fell"}
    a = frame(spark, [("unknown", 0.0, None), ("unknown", 1.0, 0.0), ("x", 0.0, 0.0), (None, None, None)], "item string, variance_amount double, variance_pct double")
    assert alerts.valid_alerts(a).count() == 2
    m = frame(spark, [(THEN, 1.0, 2.0), (NOW, 3.0, 4.0)], "period date, r double, q double")
    assert {tuple(r) for r in alerts.metric_totals(m, ("r", "q"), NOW, THEN).collect()} == {("r", 3, 1), ("q", 4, 2)}
    s = frame(spark, [(2, "p", "a", 1.0), (2, "p", "b", -5.0), (2, "p", "c", 2.0), (1, "p", "p", 9.0)], "level int, p string, item string, variance_dollar double")
    assert [(r.p, r.variance, r.movers) for r in alerts.regional_signals(s, "p", 2, 2).collect()] == [("p", -2, ["b", "c"])]
