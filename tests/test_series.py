"""Change points, lead and lag, and the periods that queries compare."""

import datetime as dt
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.operators import grouped
from ebbline.operators import stats as st
from ebbline.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _every_cut(v, penalty, least):
    """The cheapest cut by trying each start for each end."""
    n = len(v)
    best, back = [0.0] + [np.inf] * n, [0] * (n + 1)
    for end in range(least, n + 1):
        costs = [best[s] + ((v[s:end] - v[s:end].mean()) ** 2).sum() + penalty if best[s] < np.inf else np.inf for s in range(end - least + 1)]
        back[end] = int(np.argmin(costs))
        best[end] = costs[back[end]]
    cuts, end = [], n
    while end > 0 and (end := back[end]) > 0:
        cuts.append(end)
    return cuts[::-1]


@pytest.mark.parametrize("least", [1, 3, 5])
def test_cuts_by_trying_all(least):
    rng = np.random.default_rng(least)
    for k in range(60):
        n = int(rng.integers(least, 90))
        v = rng.normal(0, 1, n) + 4 * np.repeat(rng.normal(0, 1, 1 + n // 12), 12)[:n] + 1e6 * (k % 2)

        penalty = float(rng.choice([0.5, 3.0, 20.0]))
        assert grouped.cheapest_cuts(v, penalty, least) == _every_cut(v - v.mean(), penalty, least)
    assert grouped.cheapest_cuts(np.zeros(0), 1.0, 3) == [] and grouped.cheapest_cuts(np.full(50, 7.0), 1.0, 3) == []


def test_long_series_are_cut_in_seconds():
    rng = np.random.default_rng(0)
    for v in (rng.normal(0, 1, 100_000), rng.normal(0, 1, 100_000) + 5 * (np.arange(100_000) > 40_000)):
        began = time.process_time()
        cuts = grouped.cheapest_cuts(v, 3 * np.var(v) * np.log(len(v)), 3)
        assert time.process_time() - began < 20  # trying all starts takes 5 * 10^9 steps
        assert cuts == ([] if abs(v.mean()) < 1 else [40_001])


def test_changes_compare_all_before_with_all_after(spark):
    """The golden rows: means, size, percent and confidence of everything before and after each change."""
    a = [10.0, 12.0, 11.0, 9.0] * 5
    v = [*a, *[100 + x for x in a], *[200 + x for x in a]]
    flat = [5.0] * 10 + [50.0] * 10
    days = [dt.date(2020, 1, 1) + dt.timedelta(30 * k) for k in range(60)]
    rows = [("x", d, float(y)) for d, y in zip(days, v, strict=True)] + [("flat", d, y) for d, y in zip(days, flat)] + [("short", days[0], 1.0)]
    got = {(r.item, r.change_point_index): r for r in grouped.change_points(spark.createDataFrame(rows, "item string, period date, value double")).collect()}
    assert set(got) == {("x", 20), ("x", 40), ("flat", 10)}
    for cut in (20, 40):
        r, before, after = got[("x", cut)], np.array(v[:cut]), np.array(v[cut:])
        assert (r.before_mean, r.after_mean) == (pytest.approx(before.mean()), pytest.approx(after.mean())) and (r.periods_before, r.periods_after, r.period) == (cut, 60 - cut, days[cut])
        assert r.magnitude_dollar == pytest.approx(after.mean() - before.mean()) and r.magnitude_pct == pytest.approx(100 * (after.mean() / before.mean() - 1))
        assert r.confidence_score == pytest.approx(min(10.0, (after.mean() - before.mean()) / before.std()))
    assert got[("flat", 10)].confidence_score == 0.0  # nothing varied before


def _wide(spark, **series):
    rows = [(k + 1, *map(float, v)) for k, v in enumerate(zip(*series.values(), strict=True))]
    return spark.createDataFrame(rows, f"period_idx int, {', '.join(f'{n} double' for n in series)}")


def test_a_pair_leads_one_way_only(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=40)
    b = np.concatenate([rng.normal(size=2), -a[:-2]]) + 0.05 * rng.normal(size=40)  # a leads b by two, the other way round
    season = np.sin(np.arange(40) * np.pi / 3)
    wide = _wide(spark, a=a, b=b, c=season, d=np.roll(season, 1))
    got = {(r.leader, r.follower): r for r in st.lead_lag(wide, ("a", "b", "c", "d")).collect()}
    r = got[("a", "b")]
    assert r.optimal_lag == 2 and r.lag_r < -0.9 and ("b", "a") not in got
    assert r.lag_r == pytest.approx(np.corrcoef(a[:-2], b[2:])[0, 1])
    assert ("c", "d") in got or ("d", "c") in got
    assert not {("c", "d"), ("d", "c")} <= set(got)


def test_short_series_have_no_leader(spark):
    a = [1.0, 5, 2, 8, 3, 9, 4, 7, 6, 2, 8]
    assert st.lead_lag(_wide(spark, a=a, b=[0.0, *a[:-1]]), ("a", "b")).count() == 0  # 11 periods
    more = [*a, 3.0, 5.0]
    assert [(r.leader, r.optimal_lag) for r in st.lead_lag(_wide(spark, a=more, b=[0.0, *more[:-1]]), ("a", "b")).collect()] == [("a", 1)]
    gaps = _wide(spark, a=more, b=[0.0, *more[:-1]]).withColumn("b", F.when(F.col("period_idx") > 8, F.col("b")))
    assert st.lead_lag(gaps, ("a", "b")).count() == 0  # five points a lag


@pytest.fixture(scope="module")
def shorter(spark, tmp_path_factory):
    """The tables without the orders of the last two months and a half."""
    top = str(tmp_path_factory.mktemp("shorter"))
    for t in os.listdir(SF):
        if t != "orders.parquet":
            os.symlink(f"{SF}/{t}", f"{top}/{t}")
    spark.read.parquet(f"{SF}/orders.parquet").filter(F.to_date("o_orderdate") <= F.lit("2001-05-20").cast("date")).write.parquet(f"{top}/orders.parquet")
    return top


def test_queries_follow_the_calendar(spark, shorter):
    """The full table ends two months later than the shorter one: queries of the latest complete month answer about another month."""
    from ebbline.plans.facts import latest

    assert latest(spark, SF)[0] == dt.date(2001, 7, 31) and latest(spark, shorter) == (dt.date(2001, 4, 30), dt.date(2000, 4, 30))
    rows = lambda name, top: sorted(map(str, QUERIES[name](spark, top).collect()))
    for name in ("j01_current_prior", "a16_level_sums", "v11_delta_attribution", "v14_price_volume", "d10_utilisation", "t13_concentration", "l18_network_totals", "w18_scope_entities"):
        assert rows(name, SF) != rows(name, shorter), name


def test_no_query_names_its_month():
    import ebbline.plans as plans

    pinned = {"j11_event_calendar", "j12_wildcard_rules"}  # a date is the rule
    from ebbline.plans.registry import SQL

    assert {n for n, sql in SQL.items() if "2001-07-31" in sql or "2000-07-31" in sql} <= pinned
    for f in os.listdir(os.path.dirname(plans.__file__ or plans.__path__[0]) if plans.__file__ else plans.__path__[0]):
        if f.endswith(".py"):
            with open(os.path.join(plans.__path__[0], f), encoding="utf-8") as text:
                assert "date(2001, 7" not in text.read()
